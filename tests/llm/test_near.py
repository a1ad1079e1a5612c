"""Near duplicates against all pairs."""

from __future__ import annotations

import random
from functools import partial

import brute
import numpy as np
import pyarrow as pa
from conftest import plan_of

from tablekit.llm import near, texts
from tablekit.llm.components import components

SCHEMA = "doc_id long, text string, node long, component string"


def rows_of(rng):
    rows, number = [], 0
    for family in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 6, 20, 80, 300]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, len(copy) // 20])):
                copy[rng.randrange(len(copy))] = rng.choice(["X", "Y"]) + str(rng.randrange(9))
            rows.append((number, " ".join(copy).replace("w1", "W1" if family % 2 else "w1")))
            number += 1
    return [*rows, (900, ""), (901, None), (902, " \n "), (903, "a b"), (904, "A  b"), (905, "the " * 3000)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "c") for d, t in rows], SCHEMA)


def test_as_all_pairs(spark):
    rows = rows_of(random.Random(11))
    got = near.near_duplicates(frame(spark, rows)).collect()
    expected = brute.near_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_one_row_of_each_class_stays(spark):
    rows = [(3, "a b c d e"), (3, "a b c d e"), (5, "A b c d e"), (None, "q r s t"), (7, "other words stand here")]
    kept = near.without_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "node", "component"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "7", "None"]


def test_texts_are_not_shuffled_to_choose_rows(spark, monkeypatch):
    """Whichever of the kept and the dropped rows are fewer, and where both are too many."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        for copies in (2, 9):
            rows = [(10 * c + n, f"one two three {c} " * 9) for c in range(4) for n in range(copies if c < 2 else 1)]
            wanted = sorted({text: (number, text) for number, text in reversed(rows)}.values())
            for limit in (near.MAX_BROADCAST_KEYS, 0):
                monkeypatch.setattr(near, "MAX_BROADCAST_KEYS", limit)
                kept = near.without_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
                assert sorted(tuple(r) for r in kept.collect()) == wanted
                assert ("SortMergeJoin" in plan_of(kept)) == (limit == 0)
            monkeypatch.undo()
    finally:
        spark.conf.set(threshold, before)


def test_unlike_rows_that_share_an_id_stay(spark):
    unlike = ["q r s t", "other words stand here", "nothing of this is said twice"]
    rows = [(d, f"{text} {d}") for d in (None, 3) for text in unlike]
    rows += [(3, None), (3, ""), (3, "x y z x y z"), (3, "X y z x y z"), (None, "k l m n"), (4, "k l m n"), (2, "x  y z x y z")]
    kept = near.without_duplicates(frame(spark, rows)).collect()
    expected = [*rows[:8], (None, "k l m n"), (2, "x  y z x y z")]
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(d), str(t)) for d, t in expected)


def test_smallest_text_of_the_smallest_id_stays(spark):
    rows = [(5, "b c d e"), (5, "B c d e"), (5, "B  c d e"), (None, "v w x y"), (None, "V w x y"), (7, "A c d e"), (7, "b c d e")]
    kept = near.without_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == [("5", "B  c d e"), ("7", "A c d e"), ("None", "V w x y")]


def test_rows_that_share_an_id_are_linked(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "v w x y z"), (4, "v w x y z"), (9, "alone it is")]
    got = {(r.doc_id, r.component_id) for r in near.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(1, 1), (2, 1), (4, 1), (9, 9)}


def test_empty_table(spark):
    assert near.near_duplicates(frame(spark, [])).collect() == []


def test_no_bin_stays_empty():
    rng = np.random.default_rng(2)
    prints = np.sort(rng.integers(0, 2**63, 7, dtype=np.uint64))
    signature = near.densified(prints, np.array([0, 1, 1, 7]), near.BINS)
    assert (signature[[0, 2]] != near.EMPTY_BIN).all() and (signature[1] == near.EMPTY_BIN).all()


def copies_of(rng, n, changes):
    base = [f"b{i}" for i in range(120)]
    out = []
    for k in range(n):
        words = list(base)
        for at in rng.sample(range(120), changes):
            words[at] = f"x{k}_{at}"
        out.append((k, " ".join(words)))
    return out


def test_copies_below_the_threshold_are_not_all_paired(spark, monkeypatch):
    """Copies that are nearer to a text than to each other, but not near enough: each costs
    a star, and the sets of all pairs don't travel."""
    rows = [(-1, " ".join(f"b{i}" for i in range(120))), *copies_of(random.Random(3), 80, 6)]
    edges, confirm = [], near._confirm
    monkeypatch.setattr(near, "_confirm", lambda r, e, *rest: edges.append(e.count()) or confirm(r, e, *rest))
    got = near.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_components(rows)
    assert sum(edges) < 10 * len(rows) < 81 * 80 // 2


def test_small_blocks_as_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near, "confirmed_links", partial(near.confirmed_links, block=3))
    for seed in (1, 2):
        rows = [*rows_of(random.Random(seed)), *[(2000 + d, t) for d, t in copies_of(random.Random(seed), 40, 2)]]
        got = near.near_duplicates(frame(spark, rows)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_components(rows)


def test_sketches_leave_out_no_similar_pair():
    rng = random.Random(8)
    rows = [t for _, t in rows_of(rng) if t and t.split()] + [t for k in (1, 2, 3) for _, t in copies_of(rng, 15, k)]
    for block in texts.blocks(pa.array(rows)):
        prints, first = near.shingle_sets(block, 4)
        sets = [set(prints[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
        odd, n, own = near.odd_sketches(prints, first).to_pylist(), np.diff(first), np.arange(block.rows)
        for side in (np.zeros(block.rows, int), own % 2):
            a, b = near.plausible(side, own, n, odd, 80, False)
            found = {frozenset(p) for p in zip(a.tolist(), b.tolist(), strict=True)}
            for i in own.tolist():
                for j in range(i):
                    alike = 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
                    apart = side.max() > 0 and side[i] == side[j]
                    assert not alike or apart or frozenset((i, j)) in found
            assert len(found) < block.rows * (block.rows - 1) // 4


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, i) for i in range(101, 130)] + [(5, 7), (7, 5)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.component for r in got if r.doc < 100 and r.doc > 9} == {10}
    assert {r.component for r in got if r.doc >= 100} == {100}
    assert {r.doc: r.component for r in got if r.doc < 9} == {5: 5, 7: 5}
