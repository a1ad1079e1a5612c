"""Quality rules and quality scores."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

from tablekit.llm import quality_model, rules


def measures(text):
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= set(range(i, i + 5))
    return (
        len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(covered),
    )


def test_measures_and_base_verdict(spark):
    rng = random.Random(3)
    texts = ["", None, " \n\t", "a b c d e " * 40, "word\n" * 30, "x|y #1 $%&*<> é ü", "w" * 200_000]
    texts += [" ".join(rng.choice("ab cd é f".split()) for _ in range(rng.randrange(200))) for _ in range(40)]
    rows = [(i, t, 1, "k") for i, t in enumerate(texts)] + [(None, "the end of it", 2, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string")
    got = rules.judged(df).collect()
    assert len(got) == len(rows)
    for r in got:
        m = measures(r.row.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        assert r.kept == (not r.base_failed and not r.failed_rules)
    kept = rules.kept(df)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)
    assert rules.kept(df.limit(0)).collect() == []


def test_rules_leave_good_documents_alone(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    judged = rules.judged(docs).select("row.doc_id", "kept", "base_failed").join(labels, "doc_id").collect()
    good = [r for r in judged if r.quality == 1 and not r.base_failed]
    bad = [r for r in judged if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good) and sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_held_out_scores(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality_model.query(spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in got]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_scores_of_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, "good words here", 0.1), (2, None, 0.2), (3, "", 0.3), (None, "x " * 3000, 0.4), (1, "good words here", 0.5)],
        "doc_id long, text string, score double",
    )
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 0, 0), (9, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.scored(docs, *quality_model.fit(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    none = quality_model.scored(docs, *quality_model.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_model.scored(docs.limit(0), np.zeros(quality_model.SLOTS), 0.0).collect() == []


def test_one_row_of_each_id_is_trained_on(spark):
    rows = [(1, f"good words number{i} here") for i in range(30)] + [(2, "bad stuff of all kinds"), (3, "more good words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    smallest = docs.selectExpr("doc_id", "text", "row_number() over (partition by doc_id order by xxhash64(text)) AS n").where("n = 1")
    table, bias = quality_model.fit(docs, labels)
    expected, other = quality_model.fit(smallest.select("doc_id", "text"), labels)
    assert bias == other and table.any() and (table == expected).all()
