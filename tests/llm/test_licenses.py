"""License notices: base places word by word, fuzzy matches by edit distance."""

from __future__ import annotations

import random

import brute
import pytest

from tablekit.llm import licenses

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def base(text):
    """(n_words, places) as the contract says."""
    words = brute.WORD.findall(brute.lower(text or ""))
    places = []
    for phrase, label in PHRASES.items():
        want = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    return len(words), sorted(places)


def least_edits(phrase, text):
    """Row of the fewest edits from ``phrase`` to ``text[:j]`` for every j."""
    row = list(range(len(text) + 1))
    for i, c in enumerate(phrase, 1):
        left, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (c != d))
    return row


def fuzzy(notice, joined):
    """Whether a notice is somewhere between word ends, by all splits into its parts."""
    for start in (i + 1 for i, c in enumerate(joined[:-1]) if c == " "):
        tail = joined[start : start + len(notice.text) + notice.edits]
        states = {0: 0}
        for i, part in enumerate(notice.parts):
            reached = {}
            for at, edits in states.items():
                if i % 2:
                    ends = {len(part): 0} if tail.startswith(part, at) else {}
                else:
                    ends = dict(enumerate(least_edits(part, tail[at:])))
                for size, more in ends.items():
                    if edits + more <= notice.edits:
                        reached[at + size] = min(edits + more, reached.get(at + size, 99))
            states = reached
        if any(joined[start + at] == " " for at in states):
            return True
    return False


def docs_of(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_words int, labels string")


def texts():
    rng = random.Random(5)
    out = []
    for _ in range(120):
        notice = rng.choice(licenses.NOTICES)
        chars = list(notice.text)
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(chars))
            chars[i] = rng.choice(["", chars[i] + "x", "e", " ", chars[i] * 2])
        before = " ".join(rng.choice("the code is é under license mit".split()) for _ in range(rng.randrange(4)))
        out.append(f"{before}\n{''.join(chars)}. end, {rng.choice(licenses.NOTICES).text.title()} x")
    return out


def test_fuzzy_matches_by_edit_distance():
    finder = licenses.Finder()
    for text in texts():
        joined, _ = licenses.normalised(text)
        _, matches, _ = licenses.searched(finder, text)
        found = {m.notice for m in matches}
        assert found == {i for i, n in enumerate(licenses.NOTICES) if fuzzy(n, joined)}, text


def test_rows_as_the_contract(spark):
    rows = list(enumerate(texts())) + [(200, None), (201, ""), (202, " -;\n"), (None, "CC BY-NC"), (1, "cc by nc cc by nc")]
    rows += [(203, "under the MIT license " * 30_000), (204, "license " * 200_000), (205, "é" * 300_000), (1, rows[1][1])]
    got = licenses.scanned(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for d, t in rows:
        n, places = base(t)
        labels = ",".join(sorted({label for _, label in places}))
        ends = (places[0][0], places[-1][0]) if places else (None, None)
        want.setdefault(d, []).append((n, len(places), *ends, labels))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1) >= bool(r.n_base) and bool(r.score) == bool(r.labels)
    assert {d: sorted(x, key=str) for d, x in have.items()} == {d: sorted(x, key=str) for d, x in want.items()}


def test_spans_and_edits(spark):
    text = "Code: Lisensed under the Apachee Licence, Version 2.0 or under teh MIT license; not under the mpl license"
    (row,) = licenses.scanned(docs_of(spark, [(1, text)])).collect()
    words = licenses.normalised(text)[0].split()
    spans = {(" ".join(words[m.start : m.end]), m.label, m.edits) for m in row.found}
    assert ("under teh mit license", "mit", 2) in spans
    assert ("apachee licence version 2", "apache-2", 2) in spans
    assert ("lisensed under the apachee licence version 2", "apache-2", 3) in spans
    assert row.n_base == 0 and row.labels == "apache-2,mit"
    assert row.score == max(1 - m.edits / size for m, size in zip(row.found, (43, 24, 21), strict=True))


@pytest.mark.parametrize("text", ["permit licensed work", "under the mat license", "apache license version 1", "cc by nd", "cc bye nc"])
def test_other_licenses_are_left_alone(text):
    _, matches, base_found = licenses.searched(licenses.Finder(), text)
    assert not base_found
    assert all(licenses.NOTICES[m.notice].label == "cc-by-nd" for m in matches)


def test_empty_table(spark):
    assert licenses.scanned(docs_of(spark, [])).collect() == []
