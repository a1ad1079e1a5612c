"""Decontamination against plain window search."""

from __future__ import annotations

import hashlib
import random

import brute
import pyarrow as pa
import pytest
from conftest import plan_of

from tablekit.llm import leaks, texts


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, t, 1, "h") for d, t in docs], "doc_id long, text string, doc int, hits string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


@pytest.mark.parametrize(("sizes", "block"), [((1, 9, 10, 20), 10**9), ((0, 2, 4, 8, 12), 10**9), ((4, 11, 30), 30)])
def test_as_window_search(spark, sizes, block):
    rng = random.Random(str(sizes))
    words = "ab Cd ef é 7".split()
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "\n", "--", ", "]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 5, 30, 60]))) for i in range(60)] + [(70, None), (None, "ab " * 300), (71, "")]
    items = [(i, text(rng.choice(sizes))) for i in range(25)] + [(30, None), (31, "--")]
    got = leaks.reported(*frames(spark, docs, items), block_words=block).collect()
    expected = [(d, n, h, hashlib.sha256(s.encode()).hexdigest()) for d, n, h, s in brute.leaks(docs, items)]
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.items_sha256) for r in got) == sorted((str(a), *b) for a, *b in expected)
    assert all(r.contaminated == (r.n_hit > 0) for r in got)


def test_cleaning_leaves_no_window_and_keeps_the_rest(spark):
    item = " ".join(f"i{k}" for k in range(12))
    other = " ".join(f"i{k}" for k in range(5)) + " " + " ".join(f"o{k}" for k in range(10)) + " " + " ".join(f"i{k}" for k in range(5, 12))
    filler = " ".join(f"f{k}" for k in range(60))
    docs = [(1, f"{filler} {item}! {filler}"), (2, item), (3, "Clean, as it was.\n"), (4, f"{filler} {other} {filler}"), (5, None)]
    items = [(1, item), (2, " ".join(f"o{k}" for k in range(10)))]
    table, tests = frames(spark, docs, items)
    got = {r.doc_id: r.text for r in leaks.decontaminated(table, tests).collect()}
    assert set(got) == {1, 3, 4, 5} and got[3] == "Clean, as it was.\n" and got[5] is None
    assert got[1] == f"{filler} ! {filler}" and "o3" not in got[4] and "i7" not in got[4]
    assert [r.n_hit for r in leaks.reported(leaks.decontaminated(table, tests), tests).collect()] == [0, 0, 0, 0]


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, "a b")], [])
    assert [(r.n_words, r.n_hit) for r in leaks.reported(docs, items).collect()] == [(2, 0)]
    assert leaks.reported(docs.limit(0), items).collect() == []
    assert [r.text for r in leaks.decontaminated(docs, items).collect()] == ["a b"]


def test_one_worker_a_task_for_all_blocks_of_items(spark):
    item = " ".join(f"i{k}" for k in range(12))
    other = " ".join(f"i{k}" for k in range(5)) + " " + " ".join(f"o{k}" for k in range(10)) + " " + " ".join(f"i{k}" for k in range(5, 12))
    filler = " ".join(f"f{k}" for k in range(60))
    docs = [(1, f"{filler} {item}! {filler}"), (2, item), (3, "Clean."), (4, f"{filler} {other} {filler}"), (5, None), (6, "")]
    table, tests = frames(spark, docs, [(1, item), (2, " ".join(f"o{k}" for k in range(10))), (3, "clean")])
    for frame in (
        leaks.reported(table, tests),
        leaks.reported(table, tests, block_words=1),
        leaks.decontaminated(table, tests),
        leaks.decontaminated(table, tests, block_words=1),
    ):
        assert plan_of(frame).count("MapInArrow") == 1
    one, several = (sorted(map(tuple, leaks.decontaminated(table, tests, block_words=n).collect())) for n in (10**9, 1))
    assert [r[0] for r in one] == [1, 4, 5, 6] and one == several
    assert one[0][1] == f"{filler} ! {filler}" and "o3" not in one[1][1] and "i7" not in one[1][1]


def test_arrays_of_a_batch_are_small(monkeypatch):
    known = leaks.Matcher([("x", "a b c")], 3)
    sizes = []
    prints = leaks.word_prints
    monkeypatch.setattr(leaks, "word_prints", lambda block: sizes.append(len(block.data)) or prints(block))
    rows = ["a b c d " * 2000] * 300
    got = list(leaks._matches([known], pa.array(rows)))
    assert len(got) == 300 and all(n == 8000 and len(h) == 4000 and i == {"x"} for n, h, i in got)
    assert sum(sizes) == sum(map(len, rows)) and max(sizes) <= 1 << 19 < texts.BLOCK_BYTES
