"""License notices in texts, found although they are misspelt or mistyped.

A notice is a short phrase that may stand in a text with a few edits (inserted, deleted
or replaced characters). A phrase that is cut into one piece more than it may have edits
keeps at least one piece unharmed, wherever the edits fall. So an automaton looks for
the exact pieces, the *seeds*, of all notices at once; around each seed a window as long
as the notice and its edits is cut out, and the ``regex`` library looks for the best match
within bounded errors there. Words that tell licenses apart (``mit``, a version) are
exact parts of the patterns, so that an edit doesn't turn one license into another.

Texts are lower-cased (A-Z) and cut into words; notices are matched against the words
joined by single blanks, from the start of a word to the end of one. Of overlapping
matches of a notice the one with fewest edits stays, then the leftmost.

The base phrases are notices too: a text that holds one holds all of its seeds. Their
places are counted exactly in texts with such seeds, so overlapping places all count.

Rows are judged one by one without a shuffle, so ties, repeated rows and null ids need
no rule. A null text is empty and has no words. Other columns are not looked at. A very
long text is searched whole; beside it and its words a task holds one match for each
seed found. Windows that read alike are matched once in a while (``SEEN`` of them are
remembered). An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.llm import tables

SEEN = 4096


@dataclass(frozen=True)
class Notice:
    """A phrase of ``parts`` that may have ``edits`` edits, all outside its exact parts.

    Every other part is exact: the second, the fourth and so on.
    """

    label: str
    parts: tuple[str, ...]
    edits: int
    base: bool = False

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def pattern(self) -> str:
        errors = f"{{e<={self.edits}}}" if self.edits else ""
        loose = [f"(?:{regex.escape(p)}){errors}" if i % 2 == 0 and p else regex.escape(p) for i, p in enumerate(self.parts)]
        return f"(?b)(?<= )(?:{''.join(loose)})(?= )"

    def seeds(self) -> list[tuple[int, str]]:
        """The pieces and where in the phrase they start."""
        n, pieces = len(self.text), self.edits + 1
        cuts = [n * i // pieces for i in range(pieces + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


# The phrases whose places are counted, with their labels.
BASE = (
    Notice("mit", ("under the ", "mit", " license"), 2, True),
    Notice("apache-2", ("apache license version ", "2"), 2, True),
    Notice("cc-by-nc", ("", "cc by nc"), 0, True),
)
# Further short notices of public licenses.
FURTHER = (
    Notice("mit", ("permission is hereby granted free of charge to any person",), 3),
    Notice("apache-2", ("licensed under the apache license version ", "2"), 3),
    Notice("gpl-2", ("gnu general public license version ", "2"), 3),
    Notice("gpl-3", ("gnu general public license version ", "3"), 3),
    Notice("lgpl", ("gnu ", "lesser", " general public license"), 3),
    Notice("agpl-3", ("gnu ", "affero", " general public license"), 3),
    Notice("mpl-2", ("mozilla public license version ", "2"), 3),
    Notice("bsd", ("redistribution and use in source and binary forms",), 3),
    Notice("isc", ("permission to use copy modify and or distribute this software",), 3),
    Notice("unlicense", ("free and unencumbered software released into the public domain",), 3),
    Notice("cc-by-nc", ("creative commons attribution ", "noncommercial"), 3),
    Notice("cc-by-sa", ("creative commons attribution ", "sharealike"), 3),
    Notice("cc-by-sa", ("", "cc by sa"), 0),
    Notice("cc-by-nd", ("", "cc by nd"), 0),
)
NOTICES = BASE + FURTHER

# Bytes of words in lower case; all others become blanks.
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def normalised(text: str) -> tuple[str, int]:
    """The words between single blanks, with one at either end, and their number."""
    words = text.encode().translate(_TO_WORDS).split(b" ")
    words = [w for w in words if w]
    return " " + "".join(w.decode() + " " for w in words), len(words)


@dataclass(frozen=True)
class Match:
    """A notice at words ``start`` to ``end`` (exclusive)."""

    notice: int
    start: int
    end: int
    edits: int


class Finder:
    """All notices in a text."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES) -> None:
        self.notices = notices
        self.patterns = [regex.compile(n.pattern()) for n in notices]
        places: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            for offset, seed in notice.seeds():
                places.setdefault(seed, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for seed, where in places.items():
            self.automaton.add_word(seed, (len(seed), where))
        self.automaton.make_automaton()
        self.verified = lru_cache(SEEN)(self._verified)

    def _verified(self, notice: int, window: str) -> tuple[int, int, int] | None:
        """Start, end and edits of the best match in a window."""
        m = self.patterns[notice].search(window)
        if m is None or sum(m.fuzzy_counts) > self.notices[notice].edits:
            return None
        return m.start(), m.end(), sum(m.fuzzy_counts)

    def candidates(self, text: str) -> set[tuple[int, int]]:
        """Notices and where in the text they would start, had they no edits."""
        found = set()
        for last, (size, where) in self.automaton.iter(text):
            for notice, offset in where:
                found.add((notice, last + 1 - size - offset))
        return found

    def matches(self, text: str, candidates: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """Notice, first and last character (exclusive) and edits of matches that don't overlap."""
        found = set()
        for notice, at in candidates:
            slack = self.notices[notice].edits
            low = max(0, at - slack - 1)
            window = text[low : at + len(self.notices[notice].text) + slack + 1]
            best = self.verified(notice, window)
            if best is not None:
                found.add((notice, best[2], low + best[0], low + best[1]))
        kept: list[tuple[int, int, int, int]] = []
        taken: dict[int, list[tuple[int, int]]] = {}
        for notice, edits, start, end in sorted(found):
            spans = taken.setdefault(notice, [])
            if not _overlaps(spans, start, end):
                kept.append((notice, start, end, edits))
        return sorted(kept, key=lambda m: (m[1], m[0]))


def _overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a span meets one of the sorted ``spans``; if not, it is put among them."""
    i = bisect_left(spans, (start, end))
    if (i < len(spans) and spans[i][0] < end) or (i and spans[i - 1][1] > start):
        return True
    spans.insert(i, (start, end))
    return False


def word_numbers(text: str, places: list[int]) -> dict[int, int]:
    """Number of the word that starts at each place, the places in rising order."""
    numbers, word, at = {}, 0, 1
    for place in places:
        word += text.count(" ", at, place)
        numbers[place] = word
        at = place
    return numbers


def base_places(text: str, phrase: str) -> list[int]:
    """Every place where the words of a phrase stand consecutively."""
    found, at = [], text.find(f" {phrase} ")
    while at >= 0:
        found.append(at + 1)
        at = text.find(f" {phrase} ", at + 1)
    return found


def searched(finder: Finder, text: str) -> tuple[int, list[Match], list[tuple[int, int]]]:
    """Number of words, matches, and the places (word, notice) of base phrases."""
    joined, n_words = normalised(text)
    candidates = finder.candidates(joined)
    if not candidates:
        return n_words, [], []
    spans = finder.matches(joined, candidates)
    seeded = sorted({i for i, _ in candidates if finder.notices[i].base})
    exact = [(p, i) for i in seeded for p in base_places(joined, finder.notices[i].text)]
    places = sorted({*(s[1] for s in spans), *(s[2] + 1 for s in spans), *(p for p, _ in exact)})
    number = word_numbers(joined, places)
    matches = [Match(i, number[start], number[end + 1], edits) for i, start, end, edits in spans]
    return n_words, matches, sorted((number[p], i) for p, i in exact)


FOUND = "array<struct<label:string,start:long,end:long,edits:int>>"
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    f"labels string, score double, found {FOUND}"
)


def _similarity(notice: Notice, edits: int) -> float:
    return 1.0 - edits / len(notice.text)


def scanned(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """Per document the counts, labels and score, and ``found``: label, words and edits of each match.

    ``score`` is the likeness of the best match, one less its edits by its length, and
    one where a base phrase stands unharmed; without a match it is zero.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(notices)
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            for text in batch["text"]:
                n_words, matches, base = searched(finder, text.as_py())
                base_labels = {notices[i].label for _, i in base}
                labels = base_labels | {notices[m.notice].label for m in matches}
                scores = [_similarity(notices[m.notice], m.edits) for m in matches] + [1.0] * bool(base)
                out["n_words"].append(n_words)
                out["n_base"].append(len(base))
                out["first_word"].append(base[0][0] if base else None)
                out["last_word"].append(base[-1][0] if base else None)
                out["base_labels"].append(",".join(sorted(base_labels)))
                out["labels"].append(",".join(sorted(labels)))
                out["score"].append(max(scores, default=0.0))
                out["found"].append(
                    [{"label": notices[m.notice].label, "start": m.start, "end": m.end, "edits": m.edits} for m in matches]
                )
            columns = [batch["doc_id"], *(pa.array(out[n], types[n]) for n in names)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names])

    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
    types = {
        "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
        "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "found": pa.list_(span),
    }
    names = list(types)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return rows.mapInArrow(scan, SCHEMA)


def query(spark, folder: str) -> DataFrame:
    out = scanned(tables.read(spark, folder, "documents"))
    spans = F.transform("found", lambda m: F.concat_ws(":", m["label"], m["start"], m["end"], m["edits"]))
    return out.withColumn("spans", F.array_join(spans, ",")).drop("found")
