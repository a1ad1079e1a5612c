"""The stages of the pipeline on nulls, repeats, very long texts, odd names and no rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, `x.y` string, key int"
FILTERS = corpus_pipeline.STAGES[:-1]


def prose(seed, n=60):
    return " ".join(f"{w} {w}{seed}x{i}" for i, w in zip(range(n), "the and of to in is a that it was for on".split() * n, strict=False))


def odd_rows():
    rows = [(i, prose(i)) for i in range(6)]
    rows += [(3, prose(3)), (None, prose(50)), (None, prose(51)), (7, None), (8, ""), (9, prose(9, 60_000)), (10, prose(2))]
    return [(d, t, None, "s", None if t is None else len(t), "odd", 1) for d, t in rows]


@pytest.mark.parametrize(("name", "stage"), FILTERS, ids=[n for n, _ in FILTERS])
def test_stage_takes_odd_rows(spark, folder, name, stage):
    df = spark.createDataFrame(odd_rows(), COLUMNS)
    out = stage(spark, df, folder)
    assert out.columns == df.columns
    rows = out.collect()
    kept = {(r.doc_id, (r.text or "")[:20]) for r in rows}
    # Clean, unlike documents stay, with and without an id, very long ones too.
    for d, t in [(i, prose(i)) for i in (0, 1, 2, 3)] + [(None, prose(50)), (None, prose(51)), (9, prose(9))]:
        assert (d, t[:20]) in kept
    assert all(r["x.y"] == "odd" for r in rows)
    copies = [r for r in rows if r.doc_id == 3]
    assert len(copies) == (1 if name == "near_dedup" else 2)
    assert stage(spark, df.where(F.lit(False)), folder).collect() == []
