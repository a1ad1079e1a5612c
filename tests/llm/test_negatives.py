"""Hard negatives against all scores."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablekit.llm import negatives

LONG = 2**63 - 1


def brute(rows, is_anchor, positives=5, keep=10, low=30, high=90):
    usable = []
    for d, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [max(min(math.floor(256 * x), LONG), -LONG - 1) for x in v]
        usable.append((-LONG - 1 if d is None else d, whole, label))
    out = Counter()
    for a, (anchor, q, label) in enumerate(usable):
        if not is_anchor(anchor):
            continue
        score = [max(min(sum(x * y for x, y in zip(q, v, strict=False)), LONG), -LONG - 1) for _, v, _ in usable]
        order = sorted((i for i in range(len(usable)) if i != a), key=lambda i: (-score[i], usable[i][0]))
        for p in [i for i in order if usable[i][2] == label][:positives]:
            fit = [i for i in order if usable[i][2] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            for rank, n in enumerate(fit[:keep], 1):
                ids = [None if usable[i][0] == -LONG - 1 else usable[i][0] for i in (p, n)]
                out[(anchor, ids[0], rank, ids[1], score[p], score[n])] += 1
    return out


def table_of(spark, rows):
    rows = [(d, v, label, "x", 1) for d, v, label in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, block string, anchor int")


def made(seed=3, n=160, dims=20):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(3)]
    return [(i, [c + rng.gauss(0, 0.7) for c in rng.choice(centres)], rng.randrange(3)) for i in range(n)]


def odd():
    """Nulls, ties, copies, shared ids, short and empty vectors, huge components."""
    rows = made()
    rows += [(200, rows[0][1], 1)] * 4 + [(0, rows[0][1], 1), (40, rows[7][1], 2), (None, rows[5][1], 0), (None, rows[6][1], 1)]
    rows += [(300, None, 1), (301, [], 1), (302, [1.0, None], 1), (303, [float("nan")] * 20, 1), (304, [float("inf")], 2)]
    rows += [(305, rows[0][1], None), (306, [0.5] * 3, 1), (320, [1.0] * 25, 2), (-40, rows[9][1], 0)]
    return rows


@pytest.mark.parametrize("block_rows", [1 << 17, 10])
@pytest.mark.parametrize("rows", [made(), odd()], ids=["plain", "odd"])
def test_all_scores(spark, rows, block_rows):
    got = negatives.mined(table_of(spark, rows), F.col("id") % 40 == 0, block_rows=block_rows).collect()
    want = brute(rows, lambda d: d != -LONG - 1 and d % 40 == 0)
    assert Counter(map(tuple, got)) == want and sum(want.values()) > 50


def test_scores_past_64_bits(spark):
    rows = [(i, [s * 10.0**e, 1.0, s * 10.0**e], i % 2) for i, (e, s) in enumerate([(3, 1), (9, 1), (12, 1), (18, 1), (30, 1), (30, -1), (300, 1), (4, 1)])]
    got = negatives.mined(table_of(spark, rows), F.col("id") % 2 == 0).collect()
    assert Counter(map(tuple, got)) == brute(rows, lambda d: d % 2 == 0)


def test_most_of_the_bitmap_is_cleared():
    """After the largest components few candidates are read on."""
    rng = np.random.default_rng(1)
    scale = 2.0 ** -np.arange(64)
    columns = np.floor(256 * rng.normal(size=(64, 5000)) * scale[:, None]).astype(np.int64)
    block = negatives.Block(np.arange(5000), np.zeros(5000, int), columns)
    seen = []
    block.scan(columns[:, 0], np.ones(5000, bool), lambda a, b, rows: seen.append(len(rows)) or b >= np.partition(a, -6)[-6])
    assert seen[0] == 5000 and seen[1] < 500 and len(seen) == 8


def test_no_anchor_and_empty_table(spark):
    assert negatives.mined(table_of(spark, made()), F.col("id") < -5).collect() == []
    assert negatives.mined(table_of(spark, []), F.col("id") % 2 == 0).collect() == []
