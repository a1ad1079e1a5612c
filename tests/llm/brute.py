"""Plain versions of the operators, for comparison on small tables."""

from __future__ import annotations

import re
from collections import defaultdict


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def without_word_repeats(rows, window):
    """{(id, text): (n_words, n_removed, kept)}; a null id sorts first."""
    key = lambda d: -(2**63) if d is None else d
    first = {}
    split = [(d, t, (t or "").encode().split()) for d, t in rows]
    for d, _, words in split:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, key(d)), key(d))
    out = {}
    for d, t, words in split:
        stays = [True] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < key(d):
                stays[i : i + window] = [False] * window
        kept = b" ".join(w for w, s in zip(words, stays, strict=True) if s).decode()
        out[(d, t)] = (len(words), len(words) - sum(stays), kept)
    return out


def without_byte_repeats(rows, window):
    """{id: (n_bytes, n_removed, n_spans, kept)} for unlike ids."""
    seen, out = set(), {}
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        data = (text or "").encode()
        cut = [False] * len(data)
        for i in range(len(data) - window + 1):
            part = data[i : i + window]
            if part in seen:
                cut[i : i + window] = [True] * window
            seen.add(part)
        runs = sum(c and not (i and cut[i - 1]) for i, c in enumerate(cut))
        out[d] = (len(data), sum(cut), runs, bytes(b for b, c in zip(data, cut, strict=True) if not c))
    return out


def shingles(text, size=4):
    words = lower(text or "").encode().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_components(rows, percent=80):
    """{id: (n_shingles, component)} for unlike ids."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: (len(s), root(d)) for d, s in sets.items()}


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def leaks(docs, items, window=10):
    """[(id, n_words, n_hit, items)]."""
    windows = defaultdict(set)
    for item, text in items:
        words = WORD.findall(lower(text or ""))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[i : i + size])].add(str(item))
    out = []
    for d, text in docs:
        words = WORD.findall(lower(text or ""))
        hit, found = [False] * len(words), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                names = windows.get(tuple(words[i : i + size]))
                if names:
                    hit[i : i + size] = [True] * size
                    found |= names
        out.append((d, len(words), sum(hit), ",".join(sorted(found))))
    return out


PRIVATE = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def private_spans(text):
    out = []
    for rank, pattern in enumerate(PRIVATE):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            sound = (
                True,
                rank == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                12 <= len(digits) <= 19 and luhn(digits),
                9 <= len(digits) <= 15,
            )[rank]
            if sound:
                out.append((m.start(), rank, m.end()))
    return sorted(out)
