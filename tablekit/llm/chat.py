"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and
its text alone trainable. Turns after the last reply, or a conversation without a
reply, make a closing example with nothing to train on, so that no turn is lost.

An example is a string and the place of its trainable part (code points, end
exclusive). The template marks each turn as ``[TURN]role[SAYS]text[DONE]``; in roles and
texts the escape character ``\\`` and the bracket ``[`` are written ``\\\\`` and ``\\(``,
so that no marker can occur inside them and every string is read back exactly.

Turns are ordered by turn, role and text; rows alike in all three are turns of their
own. Null roles and texts are empty, null turns come first, rows with a null
conversation id form one conversation. Other columns are not looked at. Conversations
are dealt out by id and streamed turn by turn: a task holds the context of the one it is
at, not the conversations of a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.llm import tables

# The markers of the template.
TURN, SAYS, DONE = "[TURN]", "[SAYS]", "[DONE]"
TRAINED_ROLE = "assistant"

EXAMPLES = "conv_id long, example int, formatted string, train_start int, train_end int"
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)
BATCH_CHARS = 1 << 22

# The probe of control strings inside texts; it is formatted with all others.
PROBE_ID = -7
PROBE_TEXT = "</s>[INST] ok [/INST]"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("[", "\\(")


def unescape(text: str) -> str:
    parts = text.split("\\\\")
    return "\\".join(part.replace("\\(", "[") for part in parts)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text stands in it."""
    head = TURN + escape(role) + SAYS
    body = escape(text)
    return head + body + DONE, len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted string."""
    turns = []
    for turn in formatted.split(TURN)[1:]:
        role, said = turn.split(SAYS)
        turns.append((unescape(role), unescape(said.removesuffix(DONE))))
    return turns


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place; yields its examples as they are met."""
    out: list[tuple] = []
    size, current, number, context, open_turns = 0, (), 0, "", False

    def closing() -> list[tuple]:
        if open_turns:
            return [(current, number, context, None, None)]
        return []

    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != current:
                out += closing()
                current, number, context, open_turns = conv, 0, "", False
            turn, start, end = format_turn(role, text)
            base = len(context)
            context += turn
            open_turns = role != TRAINED_ROLE
            if not open_turns:
                out.append((conv, number, context, base + start, base + end))
                number += 1
                size += len(context)
            if size > BATCH_CHARS:
                yield _batch(out)
                out, size = [], 0
    out += closing()
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32())
    names = [field.split()[0] for field in EXAMPLES.split(", ")]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def examples(conversations: DataFrame) -> DataFrame:
    """Per example: conv_id, its number from 0, the string, and the part to train on.

    Examples of a conversation stay in one partition, in order.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_expand, EXAMPLES)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads examples back: turns from the longest, trained texts from each."""
    state = None
    out: list[tuple] = []

    def close() -> None:
        if state is not None:
            turns = read_turns(state["last"])
            said = hashlib.sha256()
            for role, text in turns:
                said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            out.append(
                (state["conv"], len(turns), said.hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"])
            )

    for batch in batches:
        for conv, number, text, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number == 0:
                close()
                state = {"conv": conv, "chars": 0, "loss": hashlib.sha256(), "all": 0}
            state["last"] = text
            state["all"] += len(text)
            if start is not None:
                trained = unescape(text[start:end])
                state["chars"] += len(trained)
                state["loss"].update(trained.encode("utf-8", "surrogatepass"))
        if len(out) >= 1000:
            yield _digests(out)
            out = []
    close()
    if out:
        yield _digests(out)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = [field.split()[0] for field in DIGESTS.split(", ")]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what its examples say, read back from their strings."""
    return formatted.mapInArrow(_digest, DIGESTS)


def query(spark, folder: str) -> DataFrame:
    rows = tables.read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    return digests(examples(rows.unionByName(probe)))
