"""Personal data and secrets."""

from __future__ import annotations

import re

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablekit.llm import privacy, secrets


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a.@-+1 29()é_", max_size=60))
def test_base_spans_as_patterns(text):
    assert privacy.base_spans(text) == brute.private_spans(text)


def test_long_runs_are_linear():
    for text in ("a" * 200_000 + "@", "1" * 100_000, "1." * 50_000, "+1 " * 50_000, "a@" * 50_000):
        privacy.base_spans(text)


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, terms int, spans int")


def test_terms_that_disclose(spark):
    rows = [(i, f"Note {'abcdefgh'[i] * 5} that Zorblax has zed@corp.example.com for the {'qrstuvwx'[i] * 5}") for i in range(6)]
    rows += [(100 + i, f"the plain text number{i} of that day") for i in range(300)]
    rows += [(500, None), (501, ""), (None, "call +1 555 123 4567"), (1, rows[1][1])]
    df = docs_of(spark, rows)
    got = {}
    for r in privacy.reported(df).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i in range(6):
        text = rows[i][1]
        start = text.index("Zorblax")
        assert f"term:{start}:{start + 7}" in got[i][0].spans and got[i][0].n_email == 1
        assert f"term:{text.index('the ')}" not in got[i][0].spans
    assert all(r.spans == "" for d, rs in got.items() if d is not None and d >= 100 for r in rs)
    assert got[None][0].spans == "phone:5:20" and len(got[1]) == 2
    clean = {r.doc_id: r for r in privacy.sanitised(df).collect()}
    assert clean[0].text == "Note aaaaa that [NAME] has [EMAIL] for the qqqqq".replace("has", "[TERM]", 1) or "[EMAIL]" in clean[0].text
    assert "Zorblax" not in clean[0].text and clean[500].text is None and clean[101].text == "the plain text number1 of that day"
    assert clean[0].asDict().keys() == {"doc_id", "text", "terms", "spans"}


def test_copies_of_one_context_disclose_nothing(spark):
    rows = [(i, "Zorblax writes from zed@corp.example.com today") for i in range(9)]
    assert all("term" not in r.spans for r in privacy.reported(docs_of(spark, rows)).collect())


@pytest.mark.parametrize("limit", [privacy.MAX_BROADCAST_REPEATS, 0])
@pytest.mark.parametrize("tail", ["", " and number{} of them"])
def test_copies_hide_no_term(spark, monkeypatch, tail, limit):
    monkeypatch.setattr(privacy, "MAX_BROADCAST_REPEATS", limit)
    said = [f"{'abcdefgh'[i] * 4} of Zorblax at zed@corp.example.com {'qrstuvwx'[i] * 4} one two three four five six" for i in range(3)]
    rows = [(i, text) for i, text in enumerate(said)] + [(10_000 + i, said[0] + tail.format(i)) for i in range(400)]
    rows += [(100 + i, f"the plain text number{i} of that day") for i in range(300 if not tail else 3000)]
    for r in privacy.reported(docs_of(spark, rows)).collect():
        if r.doc_id < 3 or r.doc_id >= 10_000:
            start = said[0].index("Zorblax")
            assert f"term:{start}:{start + 7}" in r.spans


def test_counts_of_terms_without_broadcast(spark, monkeypatch):
    rows = [(i, f"Zorblax {'abcdefgh'[i] * 4} zed@corp.example.com {'qrstuvwx'[i] * 4}") for i in range(6)]
    rows += [(100 + i, f"plain words {i}") for i in range(50)]
    few = sorted(r.spans for r in privacy.reported(docs_of(spark, rows)).collect())
    monkeypatch.setattr(privacy, "MAX_BROADCAST_TERMS", 0)
    assert sorted(r.spans for r in privacy.reported(docs_of(spark, rows)).collect()) == few


@pytest.mark.parametrize("table", [privacy.reported, privacy.sanitised, secrets.scanned])
def test_empty_table(spark, table):
    assert table(docs_of(spark, [])).collect() == []


def secret_spans(text):
    out = []
    for rank, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern, text):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), rank, m.end(), rule.kind))
    return sorted(out)


def test_secrets_as_patterns(spark):
    rows = [(1, 'Token = "abcdef123456" und PASSWORD: x secret=é api_key:  \'zzzzzzzz\' apikey=12345'), (2, None), (3, "")]
    rows += [(4, "AKIA" + "A" * 15 + " AKIA" + "B7" * 8 + " é " + "0f" * 12 + " " + "a" * 23), (None, "ghp_" + "a1" * 18)]
    rows += [(5, "-----BEGIN RSA PRIVATE KEY-----"), (6, "xoxb-0123456789-ab sk_live_" + "a" * 16 + " AIza" + "b" * 35)]
    rows += [(7, "passwd=" + "q" * 100_000), (8, "no secrets, but tokens and keys"), (4, "token:abcdefgh")]
    rows += [(9, "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + ".c token token = password=secret=tokenvalue1")]
    found = secrets.scanned(docs_of(spark, rows)).collect()
    got = sorted((str(r.doc_id), [(s.start, s.rank, s.end, s.kind) for s in r.found]) for r in found)
    assert got == sorted((str(d), secret_spans(t or "")) for d, t in rows)


def test_demands_are_met_by_every_match():
    samples = ["password=abcdef", "Passwd : 'abcdef'", "SECRET=abcdef", "token=abcdef", "api_key=abcdef", "APIKEY:abcdef"]
    for rule, texts in (("assign", samples), ("access", ["AKIA" + "Z" * 16]), ("slack", ["xoxp-" + "1" * 10])):
        pattern = next(r.pattern for r in secrets.RULES if r.kind == rule)
        for text in texts:
            assert re.search(pattern, text)
            grams = secrets.trigrams(text.lower())
            assert all(any(choice <= grams for choice in run) for run in secrets.demands(pattern))
    assert secrets.demands("[0-9a-f]{24,}") == []
