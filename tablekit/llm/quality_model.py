"""Quality scores from supervised subword embeddings.

A document is the average of the vectors of its words; a word is the average of its own
vector and those of its character n-grams, all found by hash in one table. A word that
stands among the ``NEAR`` words before it has one vector more, the same for all such. A softmax
layer over the average gives the classes. Table and layer are learned together by
stochastic gradient descent in numpy, on a bounded number of labelled documents.

Training takes the ``TRAIN_DOCS`` labels with the smallest hash of their id (a documented
bound; fewer if there are fewer) and, of each, one whole text: of several rows with the id
that with the smallest hash. Texts become slots where they lie; one task trains on these,
at most ``SLOTS`` of a document however long, so its memory has a bound. Scoring reads every whole text. As
everything after the table is linear, a trained table is folded into one number per
hash; it has a fixed size and goes to every task.

Labels are learned only from rows whose crc32 of the id, as text, is not 2 modulo 4;
null labels and labels of unknown documents are left out, repeated labels count again.
Null and empty texts get the score of the bias alone. Without two classes to learn from,
every score is the share of label 1, or one half without any. Rows are scored one by
one, so ties and repeats need no rule; of labels, lang, source and id none is an input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.llm import tables, texts

SLOTS = 1 << 18
DIMENSIONS = 8
GRAMS = (3, 4, 5)
TRAIN_DOCS = 6000
EPOCHS = 6
BATCH_DOCS = 32
RATE = 0.6
SEED = 7
THRESHOLD = 0.7
HELD_OUT = 2
NEAR = 8


def features(block: texts.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots of words, slots and words of n-grams, words' rows, and words per row."""
    starts, ends, first = block.words()
    sums = block.quick_sums()
    row = texts.rows_of(first)
    mask = np.uint64(SLOTS - 1)
    words = (texts.ranges(sums, starts, ends) & mask).astype(np.int64)
    lengths = ends - starts
    slots, owners = [], []
    again = np.zeros(len(words), bool)
    for back in range(1, min(NEAR, len(words) - 1) + 1):
        again[back:] |= (words[back:] == words[:-back]) & (row[back:] == row[:-back])
    owners.append(np.flatnonzero(again))
    slots.append(np.zeros(len(owners[0]), np.int64))
    for n in GRAMS:
        count = np.maximum(lengths - n + 1, 0)
        owner = np.repeat(np.arange(len(starts)), count)
        begin = starts[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
        slots.append((texts.ranges(sums, begin, begin + n) & mask).astype(np.int64))
        owners.append(owner)
    return words, np.concatenate(slots), np.concatenate(owners), row, np.diff(first)


def document_sums(block: texts.Block, folded: np.ndarray) -> np.ndarray:
    """Mean over words of the mean of their slots' numbers, per row; 0 without words."""
    words, slots, owners, row, n = features(block)
    grams = np.bincount(owners, minlength=len(words))
    total = folded[words] + np.bincount(owners, weights=folded[slots], minlength=len(words))
    word = total / (grams + 1)
    return np.bincount(row, weights=word, minlength=block.rows) / np.maximum(n, 1)


def sparse(block: texts.Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per row the distinct slots and their weights in the document's average."""
    words, slots, owners, row, n = features(block)
    share = 1 / (np.bincount(owners, minlength=len(words)) + 1) / np.maximum(n, 1)[row]
    all_rows = np.concatenate([row, row[owners]])
    all_slots = np.concatenate([words, slots])
    weights = np.concatenate([share, share[owners]])
    keys, inverse = np.unique(all_rows * SLOTS + all_slots, return_inverse=True)
    weights = np.bincount(inverse, weights=weights, minlength=len(keys))
    cut = np.searchsorted(keys, np.arange(block.rows + 1) * SLOTS)
    return [(keys[a:b] % SLOTS, weights[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """The folded table and bias: log odds of label 1 are bias plus the average."""
    positive = float(labels.mean()) if len(labels) else 0.5
    if not 0 < positive < 1:
        return np.zeros(SLOTS), 0.0 if not len(labels) else (20.0 if positive else -20.0)
    rng = np.random.default_rng(SEED)
    # Slots that no training document has stay at zero and say nothing.
    table = np.zeros((SLOTS, DIMENSIONS))
    layer = rng.uniform(-1, 1, (2, DIMENSIONS))
    bias = np.log([1 - positive, positive])
    prior = 0.5 / np.array([1 - positive, positive])
    steps = EPOCHS * -(-len(docs) // BATCH_DOCS)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), BATCH_DOCS):
            batch = order[at : at + BATCH_DOCS]
            slots = np.concatenate([docs[i][0] for i in batch])
            weights = np.concatenate([docs[i][1] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(docs[i][0]) for i in batch])
            hidden = np.zeros((len(batch), DIMENSIONS))
            np.add.at(hidden, owner, table[slots] * weights[:, None])
            scores = hidden @ layer.T + bias
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            error = scores / scores.sum(axis=1, keepdims=True)
            error[np.arange(len(batch)), labels[batch]] -= 1
            error *= prior[labels[batch]][:, None]
            rate = RATE * (1 - step / steps)
            step += 1
            gradient = error @ layer
            layer -= rate * error.T @ hidden
            bias -= rate * 0.05 * error.sum(axis=0)
            np.add.at(table, slots, -rate * 4 * gradient[owner] * weights[:, None])
    return table @ (layer[1] - layer[0]), float(bias[1] - bias[0])


MODEL = "table binary, bias double"


SPARSE = "doc_id string, slots binary, weights binary"


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in texts.blocks(batch.column(1)):
            docs = sparse(block)
            slots = pa.array([s.astype(np.int32).tobytes() for s, _ in docs], pa.binary())
            weights = pa.array([w.tobytes() for _, w in docs], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.first, block.rows), slots, weights], ["doc_id", "slots", "weights"]
            )


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    labels: list[int] = []
    for batch in batches:
        labels += batch.column(2).to_pylist()
        for slots, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            docs.append((np.frombuffer(slots, np.int32), np.frombuffer(weights, np.float64)))
    table, bias = train(docs, np.array(labels, np.int64))
    yield pa.RecordBatch.from_pydict(
        {"table": pa.array([table.astype(np.float32).tobytes()], pa.binary()), "bias": [bias]}
    )


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, float]:
    """The folded table and the bias, learned from a bounded number of documents."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold != HELD_OUT))
    chosen = usable.select("doc_id", F.col("quality").cast("long").alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id", "label").limit(train_docs)
    chosen = tables.staged(chosen, "chosen")
    # At most ``train_docs`` rows of two numbers.
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = found.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    first = found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("x"))
    slots = first.select(F.col("doc_id").cast("string").alias("doc_id"), "x.text").mapInArrow(_sparse, SPARSE)
    slots = slots.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
    one = slots.join(F.broadcast(chosen), "doc_id").repartition(1).sortWithinPartitions("doc_id", "label")
    one = one.select("slots", "weights", "label")
    model = one.mapInArrow(_train, MODEL).collect()
    if not model:
        return np.zeros(SLOTS), 0.0
    return np.frombuffer(model[0]["table"], np.float32).astype(np.float64), model[0]["bias"]


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = model.value
        for batch in batches:
            parts = [document_sums(block, table) for block in texts.blocks(batch.column(1))]
            odds = np.concatenate([*parts, np.zeros(0)]) + bias
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(odds, -500, 500))))], ["doc", "score"]
            )

    return run


def scored(docs: DataFrame, table: np.ndarray, bias: float) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast((table, bias))
    out = tables.keyed(docs).mapInArrow(_score(model), "doc long, score double")
    out = out.select(tables.doc_id(), "score")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == HELD_OUT
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark, folder: str) -> DataFrame:
    docs, labels = (tables.read(spark, folder, name) for name in ("documents", "labels"))
    return scored(docs, *fit(docs, labels))
