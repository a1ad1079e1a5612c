"""Repeated passages of words, found by difference-cover anchors.

Words at positions ``p`` with ``p % period`` in a difference cover are anchors: any two
positions have a common shift that puts both on the cover. Two equal windows of
``window`` words therefore share an anchor of ``window - period + 1`` words at the same
place inside the window, although only a fifth of all positions is ever shipped.

1. Anchors are fingerprinted and dealt out by fingerprint. One that occurs in a single
   document is dropped; the others mark their documents.
2. Marks return to their documents and are extended: every window that holds a marked
   anchor is fingerprinted whole (128 bits) and dealt out. The first document of each
   window keeps it, all later ones lose its words.

Equal documents are settled by the fingerprint of all their words; only the first
takes part in step 2. Before every shuffle a task settles what repeats inside its own
rows and sends one row per fingerprint, so a fingerprint that a third of all documents
share is a row per task. Nothing is collected and nothing grows beyond a task's chunk.

Null texts are empty. A null id sorts before all others. Rows that share an id never
make each other lose words; their own positions are told apart by a tag of the text.
Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablekit.llm import tables, texts

# Perfect difference sets, whose differences give every residue once.
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (3, 6, 7, 12, 14),
    31: (1, 5, 11, 24, 25, 27),
}
WINDOW = 50
CHUNK_ROWS = 1 << 20

HIT_FIELDS = "key long, key2 long, doc long, tag long, pos int, flag byte"
HITS = pa.schema(
    [("key", pa.int64()), ("key2", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64())]
    + [("pos", pa.int32()), ("flag", pa.int8())]
)
ALONE, SENT, SETTLED = 0, 1, 2
WHOLE = -1


def cover_of(window: int) -> tuple[int, np.ndarray]:
    """Largest period with at least a third of the window left for the anchor."""
    period = max(p for p in COVERS if p == 1 or 3 * (window - p + 1) >= window)
    return period, np.array(COVERS[period])


def _hits(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(rows[field.name]).cast(field.type) for field in HITS], schema=HITS
    )


class Chunk:
    """Rows of a task, settled among themselves before they leave it."""

    def __init__(self, settle: Callable[[dict], Iterator[dict]], limit: int = CHUNK_ROWS) -> None:
        self.settle, self.limit = settle, limit
        self.parts: list[dict[str, np.ndarray]] = []
        self.size = 0

    def add(self, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.size += len(columns["key"])
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            rows = {k: np.concatenate([p[k] for p in self.parts]) for k in self.parts[0]}
            self.parts, self.size = [], 0
            for out in self.settle(rows):
                if len(out["key"]):
                    yield _hits(out)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the keys, and in that order the number of each row's group.

    The last key only orders rows within a group.
    """
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys[:-1]:
        sorted_key = key[order]
        new[1:] |= sorted_key[1:] != sorted_key[:-1]
    return order, np.cumsum(new) - 1


def _flagged(rows: dict[str, np.ndarray], settled: np.ndarray) -> dict[str, np.ndarray]:
    """Settled rows get a fingerprint of their own, so that they gather nowhere."""
    own = (rows["key"] ^ (rows["doc"] << 24) ^ rows["pos"]).view(np.uint64)
    key = np.where(settled, texts.signed(texts.mix(own)), rows["key"])
    return rows | {"key": key, "flag": np.where(settled, SETTLED, ALONE)}


def settle_windows(rows: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
    """As :func:`settle_first`; whole documents are known copies by now."""
    return settle_first(rows, whole_settled=True)


def settle_first(
    rows: dict[str, np.ndarray], whole_settled: bool = False
) -> Iterator[dict[str, np.ndarray]]:
    """Within a chunk only the smallest document of a fingerprint stays open.

    Rows keep their order, which compresses better than that of their fingerprints.
    """
    order, group = _groups(rows["key"], rows["key2"], rows["doc"])
    doc = rows["doc"][order]
    first = doc[np.flatnonzero(np.diff(group, prepend=-1))][group]
    later = np.zeros(len(order), bool)
    later[order] = doc > first
    yield _flagged(rows, later | (rows["pos"] == WHOLE) & whole_settled)


def settle_anchors(rows: dict[str, np.ndarray]) -> Iterator[dict[str, np.ndarray]]:
    """Anchors of two documents of the chunk are marked here; one of each is sent on.

    Whole documents (``pos`` below 0) are settled as windows are.
    """
    whole = rows["pos"] < 0
    yield from settle_first({k: v[whole] for k, v in rows.items()})
    rows = {k: v[~whole] for k, v in rows.items()}
    order, group = _groups(rows["key"], rows["doc"])
    doc = rows["doc"][order]
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    ends = np.append(starts[1:], len(group)) - 1
    shared = (doc[starts] != doc[ends])[group]
    settled = np.zeros(len(order), bool)
    settled[order] = shared
    yield _flagged(rows, settled)
    sent = order[starts[shared[starts]]]
    yield {k: v[sent] for k, v in rows.items()} | {"flag": np.full(len(sent), SENT)}


def _anchor_map(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    period, cover = cover_of(window)
    length = window - period + 1
    on_cover = np.zeros(period, bool)
    on_cover[cover] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(settle_anchors)
        for batch in batches:
            ids = texts.numbers(batch.column(0))
            for block in texts.blocks(batch.column(1)):
                doc, tag = ids[block.first : block.first + block.rows], block.tags()
                words, other, first = word_marks(block)
                n = np.diff(first)
                long = np.flatnonzero(n >= window)
                sums = texts.prefix_sums(words)
                yield from chunk.add(
                    key=texts.signed(texts.ranges(sums, first[long], first[long + 1])),
                    key2=texts.signed(
                        texts.ranges(texts.prefix_sums(other, 1), first[long], first[long + 1])
                    ),
                    doc=doc[long],
                    tag=tag[long],
                    pos=np.full(len(long), WHOLE),
                )
                row = texts.rows_of(first)
                place = np.arange(len(row)) - first[row]
                start = np.flatnonzero(
                    on_cover[place % period] & (n[row] >= window) & (place + length <= n[row])
                )
                yield from chunk.add(
                    key=texts.signed(texts.ranges(sums, start, start + length)),
                    key2=np.zeros(len(start), np.int64),
                    doc=doc[row[start]],
                    tag=np.zeros(len(start), np.int64),
                    pos=place[start],
                )
        yield from chunk.flush()

    return run


def word_marks(block: texts.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two fingerprints of every word, and each row's first word."""
    starts, ends, first = block.words()
    return texts.ranges(block.sums(0), starts, ends), texts.ranges(block.sums(1), starts, ends), first


def _window_map(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    period, _ = cover_of(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(settle_windows)
        for batch in batches:
            ids = texts.numbers(batch.column(0))
            offsets, marks = texts.lists_of(batch.column(2))
            copies = batch.column(3).to_pylist()
            for block in texts.blocks(batch.column(1)):
                doc, tag = ids[block.first : block.first + block.rows], block.tags()
                words, other, first = word_marks(block)
                copied = np.array(
                    [t in copies[block.first + i] for i, t in enumerate(tag.tolist())], bool
                )
                yield from chunk.add(
                    key=texts.signed(texts.mix(tag[copied].astype(np.uint64))),
                    key2=doc[copied],
                    doc=doc[copied],
                    tag=tag[copied],
                    pos=np.full(copied.sum(), WHOLE),
                )
                low, high = offsets[block.first], offsets[block.first + block.rows]
                row = texts.rows_of(offsets[block.first : block.first + block.rows + 1])
                place = marks[low:high]
                n = np.diff(first)[row]
                # Rows that share an id have each other's marks; more marks do no harm.
                used = (place < n) & ~copied[row]
                row, place, n = row[used], place[used], n[used]
                edges = np.zeros(len(words) + 1, np.int64)
                begin = np.minimum(np.maximum(place - period + 1, 0), n - window + 1)
                end = np.minimum(place, n - window) + 1
                sound = (n >= window) & (begin < end)
                np.add.at(edges, (first[row] + begin)[sound], 1)
                np.add.at(edges, (first[row] + end)[sound], -1)
                start = np.flatnonzero(np.cumsum(edges) > 0)
                of = np.searchsorted(first, start, "right") - 1
                yield from chunk.add(
                    key=texts.signed(texts.ranges(texts.prefix_sums(words), start, start + window)),
                    key2=texts.signed(texts.ranges(texts.prefix_sums(other, 1), start, start + window)),
                    doc=doc[of],
                    tag=tag[of],
                    pos=start - first[of],
                )
        yield from chunk.flush()

    return run


def _apply_map(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept = [], [], []
            hits = batch.column(2).to_pylist()
            for block in texts.blocks(batch.column(1)):
                tags = block.tags()
                for row in range(block.rows):
                    words = block.text(row).split()
                    gone = hits[block.first + row]
                    total.append(len(words))
                    if not gone:
                        removed.append(0)
                        kept.append(b" ".join(words))
                        continue
                    own = np.array([h["pos"] for h in gone if h["tag"] == tags[row]], np.int64)
                    stays = np.ones(len(words), bool)
                    if (own < 0).any():
                        stays[:] = False
                    else:
                        edges = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edges, own, 1)
                        np.add.at(edges, own + window, -1)
                        stays = np.cumsum(edges)[:-1] == 0
                    removed.append(int(len(words) - stays.sum()))
                    kept.append(b" ".join([words[i] for i in np.flatnonzero(stays)]))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc": batch.column(0),
                    "n_words": pa.array(total, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "kept": pa.array(kept, pa.binary()),
                }
            )

    return run


def marked(anchors: DataFrame) -> DataFrame:
    """Per document: places of anchors that another document has too, and the tags
    of texts that a smaller document has as a whole.

    A chunk holds one row of an anchor, unless it settled the anchor itself; then
    it sent one row more, by which other chunks learn of it.
    """
    whole = F.col("pos") == WHOLE
    settled = F.col("flag") == SETTLED
    by_key = Window.partitionBy("key", "key2")
    found = anchors.withColumns(
        {
            "_low": F.min("doc").over(by_key),
            "_high": F.max("doc").over(by_key),
            "_sent": F.max(F.when(F.col("flag") == SENT, 1)).over(by_key),
        }
    )
    shared = (F.col("_low") != F.col("_high")) | F.col("_sent").isNotNull()
    found = found.where(
        settled | F.when(whole, F.col("doc") > F.col("_low")).otherwise((F.col("flag") == ALONE) & shared)
    )
    return found.groupBy("doc").agg(
        F.collect_set(F.when(~whole, F.col("pos"))).alias("marks"),
        F.collect_set(F.when(whole, F.col("tag"))).alias("copies"),
    )


def later(hits: DataFrame) -> DataFrame:
    """Per document the rows whose fingerprint also stands in a smaller document."""
    by_key = Window.partitionBy("key", "key2").orderBy("doc")
    found = hits.withColumn("_low", F.first("doc").over(by_key))
    found = found.where((F.col("flag") == SETTLED) | (F.col("doc") > F.col("_low")))
    return found.groupBy("doc").agg(F.collect_list(F.struct("tag", "pos")).alias("gone"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed and the text that is kept.

    A word goes if a window of ``window`` words that covers it also starts in a
    document with a smaller id. Kept words are joined by single spaces.
    """
    rows = tables.keyed(docs)
    marks = marked(rows.mapInArrow(_anchor_map(window), HIT_FIELDS))
    extended = rows.join(marks, "doc").select("doc", "text", "marks", "copies")
    gone = later(extended.mapInArrow(_window_map(window), HIT_FIELDS))
    applied = rows.join(gone, "doc", "left").select("doc", "text", "gone")
    out = applied.mapInArrow(_apply_map(window), "doc long, n_words long, n_removed long, kept binary")
    return out.select(tables.doc_id(), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def query(spark, folder: str) -> DataFrame:
    out = without_repeats(tables.read(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
