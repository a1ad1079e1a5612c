"""Collocations against counts of every phrase, one by one."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import brute
import pytest

from tablekit.llm import collocations


def mined(rows, least=30, longest=4, share=80, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", brute.lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    frequent = {key: n for key, n in counts.items() if n >= least}
    best = defaultdict(list)
    for (lang, words), a in frequent.items():
        if len(words) < 2:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        covered = any(
            other == lang and len(y) > len(words) and 100 * b >= share * a
            and any(y[i : i + len(words)] == words for i in range(len(y)))
            for (other, y), b in frequent.items()
        )
        if not covered:
            score, _, left, right = min(cuts)
            best[lang].append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, found in best.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def docs_of(spark, rows):
    rows = [(i // 2, t, lang, 1, "x") for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, words string")


def corpus():
    rng = random.Random(2)
    fixed = ["New  York city hall", "of the", "machine Learning model", "É té", "a a a a a"]
    rows = []
    for _ in range(300):
        words = []
        for _ in range(rng.randrange(30)):
            words.append(rng.choice(fixed) if rng.random() < 0.4 else rng.choice("abcdefghijkl") * rng.randrange(1, 3))
            words.append(rng.choice([" ", " ", "  ", "\t", ", ", ".\n", " ", "\x0b"]))
        rows.append((rng.choice(["en", "en", "de", None]), "".join(words)))
    return rows + [("fr", None), ("fr", ""), ("fr", " .,; "), ("es", "uno dos " * 40_000), ("es", "x" * 300_000)]


@pytest.mark.parametrize("slots", [1 << 26, 3])
def test_every_phrase_counted(spark, monkeypatch, slots):
    monkeypatch.setattr(collocations, "FILTER_SLOTS", slots)
    rows = corpus()
    got = sorted(map(tuple, collocations.mined(docs_of(spark, rows)).collect()))
    assert got == mined(rows) and len(got) > 20


@pytest.mark.parametrize(("least", "longest", "share", "top"), [(2, 3, 50, 7), (5, 2, 100, 1000), (1, 4, 80, 20)])
def test_parameters(spark, least, longest, share, top):
    rows = corpus()[:60]
    got = collocations.mined(docs_of(spark, rows), least, longest, share, top).collect()
    assert sorted(map(tuple, got)) == mined(rows, least, longest, share, top)


def test_copies_all_count(spark):
    rows = [("en", "Red tape. red tape")] * 40
    (row,) = collocations.mined(docs_of(spark, rows)).collect()
    assert tuple(row) == ("en", 1, "red tape", 80, 80, 80, 160, 1_000_000)


def test_arithmetic_past_64_bits(spark, monkeypatch):
    big = 6 * 10**18
    table = spark.createDataFrame(
        [("en", [], big), ("en", ["a"], big), ("en", ["b"], 2 * 10**18 + 1), ("en", ["a", "b"], 2 * 10**18)],
        "lang string, words array<string>, f long",
    )
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: table)
    (row,) = collocations.mined(docs_of(spark, [])).collect()
    assert row.score == 2_000_000 * 2 * 10**18 // (big + 2 * 10**18 + 1) == 499_999


def test_empty_table(spark):
    assert collocations.mined(docs_of(spark, [])).collect() == []
