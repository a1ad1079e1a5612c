"""Chat formatting: exact round trips."""

from __future__ import annotations

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tablekit.llm import chat

TRICKY = st.text(alphabet="ab[]\\(TURNSAYDONE\n é", max_size=30)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), max_size=5))
def test_turns_are_read_back(turns):
    formatted = "".join(chat.format_turn(role, text)[0] for role, text in turns)
    assert chat.read_turns(formatted) == turns
    for role, text in turns:
        string, start, end = chat.format_turn(role, text)
        assert chat.unescape(string[start:end]) == text


def test_examples_and_digests(spark):
    rows = [(1, 0, "system", "be [TURN] good"), (1, 1, "user", "q"), (1, 2, "assistant", "a1"), (1, 3, "user", None)]
    rows += [(1, 4, "assistant", "a2"), (1, 5, "user", "bye"), (2, 0, "user", "only"), (3, 0, "assistant", "x" * 50_000)]
    rows += [(None, 1, None, "lost"), (4, 0, "assistant", ""), (4, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, example int")
    made = chat.examples(df).where("conv_id = 1").orderBy("example").collect()
    assert [chat.read_turns(r.formatted)[-1] for r in made] == [("assistant", "a1"), ("assistant", "a2"), ("user", "bye")]
    assert [r.formatted[r.train_start : r.train_end] for r in made[:2]] == ["a1", "a2"] and made[2].train_start is None
    got = {r.conv_id: r for r in chat.digests(chat.examples(df)).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {1: 6, 2: 1, 3: 1, 4: 2, None: 1}
    said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows if r[0] == 1)
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[1].loss_chars == 4 and got[1].loss_sha256 == hashlib.sha256(b"a1a2").hexdigest()
    assert got[3].loss_chars == 50_000 and got[2].loss_chars == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.examples(df)).collect() == []


def test_the_probe_is_part_of_the_query(spark, folder):
    probe = chat.query(spark, folder).where("conv_id = -7").first()
    assert probe.n_turns == 2 and probe.loss_chars == len(chat.PROBE_TEXT)
    assert probe.loss_sha256 == hashlib.sha256(chat.PROBE_TEXT.encode()).hexdigest()
