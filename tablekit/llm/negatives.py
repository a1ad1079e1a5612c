"""Hard negatives by a vertical scan of vector blocks (branch and bound on dimensions).

Vectors are dealt into blocks, and a block is kept column by column: one array for each
dimension. An anchor reads the columns in the order of its own components, largest
magnitude first, and adds up partial inner products. What the columns not yet read can
still add is bounded by their least and greatest value in the block, so every candidate
has a lower and an upper bound. Candidates whose bounds leave the windows, or the first
places, are cleared from the bitmap, and only the others are read on; after the last
column the bounds are exact.

Two scans are made. The first finds an anchor's positives, the best rows of its label.
Each positive then gives a window of scores, and the second scan finds the best rows of
other labels in each window. Anchors are a query set that meets all rows, block by block:
a block's rows come first in its partition, then the anchors stream past. A task holds
one block (``BLOCK_ROWS`` vectors) and a batch of anchors; blocks are dealt by a hash of
the row and its place in the scan, so neither a label nor copies of a row make one large.
A block sends on at most ``positives + 1``, or ``negatives`` for each window, of its rows
to an anchor.

Rows with a null label, a null vector, or a null or non-finite component take no part.
A null id sorts before all others and is no anchor. Rows that share an id are rows of
their own; equal rows have equal scores and each counts. Shorter vectors go on with
zeros. Components and scores past 64 bits count as the largest or smallest such number.
Order is by score, then by id, so ties have one result. Extra columns are not looked at.
An empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablekit.llm import tables, texts

BLOCK_ROWS = 1 << 17
STEP = 8
POSITIVES = 5
NEGATIVES = 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
SCALE = 256

LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)


# ---------------------------------------------------------------- in a task


class Block:
    """Vectors by column, with the least and greatest component of each."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, columns: np.ndarray) -> None:
        self.ids, self.labels, self.columns = ids, labels, columns
        self.least, self.greatest = columns.min(axis=1), columns.max(axis=1)
        self.largest = np.maximum(np.abs(self.least.astype(float)), np.abs(self.greatest.astype(float)))

    def scan(self, query: np.ndarray, bitmap: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Rows that ``keep(least, greatest)`` never cleared, and their scores."""
        size = min(len(query), len(self.columns))
        query, columns = query[:size], self.columns[:size]
        rows = np.flatnonzero(bitmap)
        if np.sum(np.abs(query.astype(float)) * self.largest[:size]) >= 2**62:
            return self._scan_wide(query, rows, keep)
        order = np.argsort(-np.abs(query), kind="stable")
        ends = np.sort(np.stack([query * self.least[:size], query * self.greatest[:size]]), axis=0)[:, order]
        rest = np.zeros((2, size + 1), np.int64)
        rest[:, :size] = np.cumsum(ends[:, ::-1], axis=1)[:, ::-1]
        scores = np.zeros(len(rows), np.int64)
        for first in range(0, max(size, 1), STEP):
            last = min(first + STEP, size)
            for d in order[first:last]:
                if query[d]:
                    scores += query[d] * (columns[d] if len(rows) == len(bitmap) else columns[d][rows])
            alive = keep(scores + rest[0, last], scores + rest[1, last], rows)
            if not alive.all():
                rows, scores = rows[alive], scores[alive]
            if not len(rows):
                break
        return rows, scores

    def _scan_wide(self, query: np.ndarray, rows: np.ndarray, keep: Callable) -> tuple[np.ndarray, np.ndarray]:
        """The same for components whose products may pass 64 bits, without bounds on the way."""
        wide = [int(q) for q in query]
        exact = [sum(q * int(c) for q, c in zip(wide, self.columns[: len(wide), r], strict=True)) for r in rows]
        scores = np.array([min(max(s, LONG_MIN), LONG_MAX) for s in exact], np.int64)
        alive = keep(scores, scores, rows)
        return rows[alive], scores[alive]

    def best(self, rows: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
        """Places of the first ``n`` by score, then by id."""
        if len(rows) > n:
            least = np.partition(scores, len(scores) - n)[len(scores) - n]
            chosen = np.flatnonzero(scores >= least)
        else:
            chosen = np.arange(len(rows))
        # The complement turns the order around without leaving 64 bits.
        return chosen[np.lexsort((self.ids[rows[chosen]], ~scores[chosen]))[:n]]

    def first_of_label(self, query: np.ndarray, label: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        def keep(least: np.ndarray, greatest: np.ndarray, rows: np.ndarray) -> np.ndarray:
            if len(rows) <= n:
                return np.ones(len(rows), bool)
            return greatest >= np.partition(least, len(least) - n)[len(least) - n]

        rows, scores = self.scan(query, self.labels == label, keep)
        best = self.best(rows, scores, n)
        return rows[best], scores[best]

    def first_in_windows(
        self, query: np.ndarray, label: int, windows: list[tuple[int, int]], n: int
    ) -> tuple[np.ndarray, np.ndarray]:
        """Rows of other labels that are among the first ``n`` of some window."""

        def keep(least: np.ndarray, greatest: np.ndarray, rows: np.ndarray) -> np.ndarray:
            alive = np.zeros(len(rows), bool)
            for low, high in windows:
                within = (greatest >= low) & (least <= high)
                sure = least[(least >= low) & (greatest <= high)]
                if len(sure) > n:
                    within &= greatest >= np.partition(sure, len(sure) - n)[len(sure) - n]
                alive |= within
            return alive

        if not windows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows, scores = self.scan(query, self.labels != label, keep)
        chosen = np.zeros(len(rows), bool)
        for low, high in windows:
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            chosen[inside[self.best(rows[inside], scores[inside], n)]] = True
        return rows[chosen], scores[chosen]


def _block(batches: list[pa.RecordBatch]) -> Block:
    parts = pa.Table.from_batches(batches).combine_chunks()
    starts, values = texts.lists_of(parts["vector"].combine_chunks())
    lengths = np.diff(starts)
    columns = np.zeros((int(lengths.max(initial=0)), len(lengths)), np.int64)
    if len(lengths):
        within = np.arange(starts[-1]) - np.repeat(starts[:-1], lengths)
        columns[within, np.repeat(np.arange(len(lengths)), lengths)] = values
    return Block(texts.numbers(parts["id"]), texts.numbers(parts["label"]), columns)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """Pieces of batches that belong to one block and are all rows or all anchors."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = texts.numbers(batch["block"])
        anchors = texts.numbers(batch["anchor"].is_valid())
        edges = np.flatnonzero((block[1:] != block[:-1]) | (anchors[1:] != anchors[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(block)], strict=True):
            yield int(block[a]), bool(anchors[a]), batch.slice(a, b - a)


def _scanned(batches: Iterator[pa.RecordBatch], positives: int, negatives: int) -> Iterator[pa.RecordBatch]:
    """What a block's rows give for each anchor: the first of its label, or of its windows."""
    number, waiting, block = None, [], None
    for this, is_anchor, piece in _runs(batches):
        if this != number:
            number, waiting, block = this, [], None
        if not is_anchor:
            waiting.append(piece)
            continue
        if not waiting and block is None:
            continue
        if block is None:
            block, waiting = _block(waiting), []
        anchors, ids, scores = [], [], []
        starts, values = texts.lists_of(piece["vector"])
        window_starts, windows = texts.lists_of(piece["windows"])
        labels, keys, asked = texts.numbers(piece["label"]), texts.numbers(piece["anchor"]), piece["windows"].is_valid()
        for i, key in enumerate(keys):
            query = values[starts[i] : starts[i + 1]]
            if asked[i].as_py():
                pairs = windows[window_starts[i] : window_starts[i + 1]].reshape(-1, 2).tolist()
                rows, found = block.first_in_windows(query, labels[i], pairs, negatives)
            else:
                rows, found = block.first_of_label(query, labels[i], positives + 1)
            anchors.append(np.full(len(rows), key))
            ids.append(block.ids[rows])
            scores.append(found)
        columns = [np.concatenate(c).astype(np.int64) for c in (anchors, ids, scores)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "id", "score"])


# ------------------------------------------------------------------ on Spark


def _taking_part(vectors: DataFrame) -> DataFrame:
    """``id``, ``label`` and whole-number ``vector`` of the rows that count."""
    values = vectors["embedding"].cast("array<double>")
    usable = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(vectors["label"].isNotNull() & values.isNotNull() & usable).select(
        F.coalesce(vectors["vec_id"].cast("long"), F.lit(tables.NULL_ID)).alias("id"),
        vectors["label"].cast("long").alias("label"),
        F.transform(values, lambda x: F.floor(x * F.lit(float(SCALE)))).alias("vector"),
    )


def _against_blocks(rows: DataFrame, anchors: DataFrame, n_blocks: int, positives: int, negatives: int) -> DataFrame:
    """Every anchor's candidates (``anchor, id, score``) from every block."""
    place = F.xxhash64("id", "label", F.monotonically_increasing_id())
    dealt = rows.select(
        F.pmod(place, F.lit(n_blocks)).cast("int").alias("block"),
        F.lit(None).cast("long").alias("anchor"),
        "id", "label", "vector",
        F.lit(None).cast("array<bigint>").alias("windows"),
    )
    # One copy of an anchor for each block: the query set against all rows, in blocks.
    copies = anchors.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "anchor", "id", "label", "vector", "windows"
    )
    met = dealt.unionByName(copies).repartitionById(n_blocks, F.col("block"))
    met = met.sortWithinPartitions("block", F.col("anchor").asc_nulls_first())
    return met.mapInArrow(lambda batches: _scanned(batches, positives, negatives), "anchor long, id long, score long")


def mined(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per anchor and positive the first rows of another label whose score is between
    two percentages of the positive's.

    ``vectors`` has ``vec_id``, ``embedding`` and ``label``; ``is_anchor`` is a condition
    on ``id``, the row's id.
    """
    spark = vectors.sparkSession
    rows = _taking_part(vectors)
    # Footers hold this count; rows that take no part only make blocks smaller.
    n_blocks = max(2 * spark.sparkContext.defaultParallelism, -(-vectors.count() // block_rows))
    anchors = rows.where(is_anchor & (F.col("id") != tables.NULL_ID))
    # Written, so that an anchor keeps its number when a task is repeated.
    anchors = tables.staged(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    unasked = anchors.withColumn("windows", F.lit(None).cast("array<bigint>"))
    near = _against_blocks(rows, unasked, n_blocks, positives, negatives)
    order = W.partitionBy("anchor").orderBy(F.desc("score"), F.asc("id"))
    near = near.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= positives + 1)
    # At most positives + 1 entries each. One of them may be the anchor itself; an entry
    # with its id and score can't be told from it in the result, so either may go.
    entry = F.struct(F.col("turn"), F.col("id"), F.col("score"))
    lists = near.groupBy("anchor").agg(F.sort_array(F.collect_list(entry)).alias("near"))
    # Squares only add up, so each sum may stop at the largest number.
    largest = F.lit(LONG_MAX).cast("decimal(38,0)")
    own = F.aggregate(
        F.transform("vector", lambda x: F.least(x.cast("decimal(38,0)") * x, largest)),
        F.lit(0).cast("decimal(38,0)"),
        lambda total, x: F.least(total + x, largest).cast("decimal(38,0)"),
    )
    others = F.expr("filter(near, (x, i) -> i + 1 <> array_position(transform(near, y -> (y.id = id) AND (y.score = own)), true))")
    judged = anchors.withColumn("own", own.cast("long")).join(lists, "anchor")
    judged = judged.withColumn("positives", F.slice(others, 1, positives))

    def bound(percent: int, up: bool) -> Column:
        """Least whole score of at least, or greatest of at most, a share of the positive's."""
        share = F.col("p.score").cast("decimal(20,0)") * percent
        return (F.ceil(share / 100) if up else F.floor(share / 100)).cast("long")

    wanted = judged.select("anchor", "id", "label", "vector", F.posexplode("positives").alias("k", "p"))
    wanted = tables.staged(
        wanted.select(
            "anchor", "id", "label", "vector", "k", F.col("p.id").alias("positive"), F.col("p.score").alias("positive_score"),
            bound(low_percent, True).alias("low"), bound(high_percent, False).alias("high"),
        ),
        "positives",
    )
    pairs = F.flatten(F.collect_set(F.array("low", "high")))
    asking = wanted.where("low <= high").groupBy("anchor").agg(pairs.alias("windows")).join(anchors, "anchor")
    far = _against_blocks(rows, asking, n_blocks, positives, negatives)
    far = far.select("anchor", F.col("id").alias("negative"), F.col("score").alias("negative_score"))
    met = wanted.drop("vector", "label").join(far, "anchor").where(F.col("negative_score").between(F.col("low"), F.col("high")))
    order = W.partitionBy("anchor", "k").orderBy(F.desc("negative_score"), F.asc("negative"))
    met = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return met.select(
        tables.doc_id("id").alias("anchor_id"),
        tables.doc_id("positive").alias("positive_id"),
        "rank",
        tables.doc_id("negative").alias("negative_id"),
        "positive_score",
        "negative_score",
    )


def query(spark, folder: str) -> DataFrame:
    vectors = tables.read(spark, folder, "embeddings")
    label = F.col("label").cast("long")
    shifted = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mined(vectors.withColumn("label", shifted), F.col("id") % 100 == 0)


SQL = f"""
WITH usable AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.id AS anchor, r.id, r.label = a.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM usable a JOIN usable r ON a.id <> r.id WHERE a.id % 100 = 0
), positives AS (
  SELECT anchor, id, score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= {POSITIVES}
)
SELECT p.anchor AS anchor_id, p.id AS positive_id, n.id AS negative_id,
  CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
  p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same
WHERE {LOW_PERCENT} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH_PERCENT} * p.score
QUALIFY rank <= {NEGATIVES}
"""
