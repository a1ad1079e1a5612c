"""Substring dedup and suffix dedup against plain versions."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from tablekit.llm import substring, suffixes, texts

SCHEMA = "doc_id long, text string, key int, flag int, _low int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], SCHEMA)


def word_rows():
    rng = random.Random(4)
    passage = " ".join(rng.choice("ab cd é f".split()) for _ in range(160))
    words = passage.split()
    rows = [(1, passage), (2, passage), (2, passage), (3, "x " + " ".join(words[40:130]) + " y")]
    rows += [(4, " ".join(words[:50])), (5, " ".join(words[1:50])), (6, ""), (7, None), (8, "z " * 500)]
    rows += [(9, "z " * 60), (None, " ".join(words[100:])), (10, " \t\n" + "\n".join(words[20:71])), (11, "w" * 5000)]
    return rows


def test_difference_sets_have_every_difference():
    for period, cover in substring.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("window", [50, 8, 1])
def test_words_as_brute_force(spark, window):
    rows = word_rows()
    expected = brute.without_word_repeats(rows, window)
    got = substring.without_repeats(frame(spark, rows), window).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted(
        (str(d), *expected[(d, t)]) for d, t in rows
    )


def test_words_of_an_empty_table(spark):
    assert substring.without_repeats(frame(spark, [])).collect() == []


@pytest.mark.parametrize("window", [100, 30])
def test_bytes_as_brute_force(spark, window):
    rng = random.Random(5)
    base = "".join(rng.choice("abcé ") for _ in range(500))
    rows = [(1, base), (2, base), (3, "ab" * 300), (4, "x" * 99), (5, "y" * 100), (6, "y" * 101), (7, ""), (8, None)]
    rows += [(9, base[:150] + "zzz" + base[100:260]), (10, base[250:351] * 2), (None, base[50:170]), (11, "q" * 3000)]
    expected = brute.without_byte_repeats(rows, window)
    got = suffixes.without_repeats(frame(spark, rows), window).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == expected
    assert len(got) == len(rows)


def test_equal_rows_are_one_document(spark):
    text = "".join(random.Random(1).choices("abcd", k=300))
    got = suffixes.without_repeats(frame(spark, [(1, text), (1, text)])).collect()
    assert [r.n_removed for r in got] == [0, 0]


def test_crowded_digits_as_brute_force(spark, monkeypatch):
    """One passage in many contexts, so that its first digit has many spans."""
    monkeypatch.setattr(suffixes, "SPANS_PER_DIGIT", 2)
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(110))
    rows = [(i, f"{rng.random()}" * 4 + passage[i % 7 :] + f"{rng.random()}" * 4) for i in range(40)]
    expected = brute.without_byte_repeats(rows, 100)
    got = suffixes.without_repeats(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == expected


def test_empty_table_of_bytes(spark):
    assert suffixes.without_repeats(frame(spark, [])).collect() == []


def test_places_of_long_texts_as_of_short_ones(monkeypatch):
    data = np.random.default_rng(3).integers(97, 101, 4000).astype(np.uint8)
    block = texts.Block(0, data, np.array([0, 1500, 4000]))
    plain = suffixes.synchronised(block, 100, 40)
    monkeypatch.setattr(suffixes, "PLACE_BITS", 10)
    wide = suffixes.synchronised(block, 100, 40)
    assert len(plain[0]) and all(len(a) for a in wide)
    # Other low bits rank equal prints alike; spans cover the same windows in both.
    for place, low, high in (plain, wide):
        covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high, strict=True)])
        assert sorted(covered) == [*range(1401), *range(1500, 3901)]
        assert (place >= high).all() and (place + 40 <= low + 100).all()
