"""The pipeline, and the registered queries with a twin in SQL."""

from __future__ import annotations

import brute
import oracle
import pytest

import corpus_pipeline
from tablekit.llm import privacy, rules, tables
from tablekit.llm.registry import QUERIES


def test_stages_against_plain_versions(spark, folder):
    docs = tables.read(spark, folder, "documents")
    columns = docs.columns
    items = [tuple(r) for r in tables.read(spark, folder, "benchmark").select("item_id", "text").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = tables.staged(stage(spark, docs, folder), name)
        assert out.columns == columns
        after = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(after)
        if name == "quality_rules":
            kept = {r.row.doc_id for r in rules.judged(docs).collect() if r.kept}
            assert set(after) == kept
        elif name == "near_dedup":
            parts = brute.near_components(list(texts.items()))
            assert set(after) == {d for d, (_, c) in parts.items() if d == c}
        elif name == "decontamination":
            hit = {d: (h, n) for d, n, h, _ in brute.leaks(texts.items(), items)}
            assert set(after) == {d for d, (h, n) in hit.items() if 100 * h <= 50 * n}
            assert all(after[d].text == texts[d] for d, (h, _) in hit.items() if d in after and not h)
            assert not any(h for _, _, h, _ in brute.leaks([(d, r.text) for d, r in after.items()], items))
        else:
            assert set(after) == set(texts)
            for d, r in after.items():
                spans = brute.private_spans(texts[d])
                if not spans:
                    assert r.text == texts[d]
                assert not [s for s in spans if texts[d][s[0] : s[2]] in r.text and len(texts[d][s[0] : s[2]]) > 12]
                assert r.n_chars == len(r.text)
        docs, texts = out, {d: r.text for d, r in after.items()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in pieces} == set(texts)
    assert privacy.base_spans("") == []


@pytest.mark.parametrize("query", [q for q in QUERIES if q.sql], ids=lambda q: q.name)
def test_matches_sql(spark, folder, query):
    assert oracle.differences(query.run(spark, folder), oracle.connect(folder), query.sql) == []


def test_every_operator_is_registered():
    assert sorted(int(q.name[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
