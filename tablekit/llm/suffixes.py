"""Repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered by their first ``window`` bytes only, most significant digit
first, and leave the sort as soon as they stand alone. A digit is a fingerprint of a
block of bytes: any order of digits will do, as only equal groups matter. Each pass
deals suffixes out by one digit (an exchange), orders them inside their bucket by the
next, and hands on what is still tied:

1. The first digit is the block of ``DIGIT`` bytes at a synchronising position: the
   place with the smallest fingerprint in the window (the last one of equals). Equal
   windows have it at equal distance, so one suffix of about thirty stands for all
   windows that chose it, its *span*. A suffix alone in its bucket leaves.
2. The second digit is the whole span. Of equal spans, all but the first are repeats.
3. Where a bucket has several spans, the first of each goes on to full depth: every
   window of its span is a suffix of its own, ordered inside the bucket by all its
   ``window`` bytes (with the digit, 112 bits of fingerprint). Equal groups are exactly
   the repeated windows; all but the first are repeats.

Before each exchange a task settles equal spans and windows among its own rows, so a
passage that a third of all documents share is a row per task. A first digit with many
different spans in one task skips pass 2 there and tells the other tasks so; in pass 3
its windows are dealt out one by one, by all their bytes.

Null texts are empty. A null id sorts before all others. Rows that share an id are
ordered by a tag of their text; equal rows count as one document. Other columns are not
looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablekit.llm import tables, texts

WINDOW = 100
DIGIT = 40
SPANS_PER_DIGIT = 32
CHUNK_ROWS = 1 << 19
BLOCK_BYTES = 1 << 20

OPEN, WITNESS, REPEAT, DEEPER, CROWDED = 0, 1, 2, 3, 4
PLACE_BITS = 23

# Spans travel in columns, a row for each bucket of a task, at half the bytes of rows.
# Digits and spans are 48 bits each: two low halves, and the high quarters of both.
SPAN_COLUMNS = {
    "digit": pa.int32(), "span": pa.int32(), "high": pa.int32(), "doc": pa.int64(), "tag": pa.int32(),
    "pos": pa.int32(), "flag": pa.int8(),
}
SPAN_FIELDS = (
    "bucket int, digit array<int>, span array<int>, high array<int>, doc array<long>, tag array<int>, "
    "pos array<int>, flag array<byte>"
)
BUCKETS_PER_PARTITION = 4
FULL = np.uint64((1 << 48) - 1)
DEEP_FIELDS = "key long, doc long, tag long, low int, high int, prints array<int>, more array<short>"
DEEP = pa.schema(
    [("key", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("low", pa.int32())]
    + [("high", pa.int32()), ("prints", pa.list_(pa.int32())), ("more", pa.list_(pa.int16()))]
)


def digit_of(window: int) -> int:
    """Bytes of the first digit: ``DIGIT`` where it fits, else a good part of the window."""
    return min(DIGIT, max(1, window * 2 // 5))


def smallest_of_each(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def synchronised(block: texts.Block, window: int, digit: int) -> tuple[np.ndarray, ...]:
    """Per chosen place: the place, and its first and last window start, in the block."""
    n, width = len(block.data), window - digit + 1
    if n < window:
        return (np.zeros(0, np.int64),) * 3
    # Which place is chosen changes no result, as long as equal windows choose alike.
    prints = texts.windows(block.quick_sums(), digit)
    low_bits = np.uint64((1 << PLACE_BITS) - 1)
    if n > int(low_bits):
        order = _wide_choice(prints, width)
    else:
        ranked = (prints & ~low_bits) | (low_bits - np.arange(len(prints), dtype=np.uint64))
        order = (low_bits - (smallest_of_each(ranked, width) & low_bits)).astype(np.int64)
    row_end = block.offsets[1:]
    window_starts = np.arange(len(order))
    row = np.searchsorted(block.offsets, window_starts, "right") - 1
    inside = window_starts + window <= row_end[row]
    chosen, at = order[inside], window_starts[inside]
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    new = np.r_[True, (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1
    return chosen[first], at[first], at[last]


def _wide_choice(prints: np.ndarray, width: int) -> np.ndarray:
    """The same choice for texts too long to keep the place in the low bits."""
    size, step = 1 << PLACE_BITS, (1 << PLACE_BITS) - width
    low_bits = np.uint64(size - 1)
    parts = []
    for at in range(0, len(prints) - width + 1, step):
        part = prints[at : at + size - 1]
        places = np.arange(len(part)).astype(np.uint64)
        best = smallest_of_each((part & ~low_bits) | (low_bits - places), width)[:step]
        parts.append((low_bits - (best & low_bits)).astype(np.int64) + at)
    return np.concatenate(parts)


def _settled(rows: dict[str, np.ndarray], *keys: str) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The rows, and whether each is the first of its group of equal leading two keys.

    Rows with the place of their group's first are that row again and are left out. The
    others keep their order, which compresses better than that of their fingerprints.
    """
    order = np.lexsort([rows[k] for k in keys[::-1]])
    ordered = {k: rows[k][order] for k in keys}
    new = np.ones(len(order), bool)
    new[1:] = np.any([np.diff(ordered[k]) != 0 for k in keys[:2]], axis=0)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    other = np.any([ordered[k] != ordered[k][first] for k in keys[2:]], axis=0)
    is_first, keep = np.zeros(len(order), bool), np.zeros(len(order), bool)
    is_first[order], keep[order] = new, new | other
    return {k: v[keep] for k, v in rows.items()}, is_first[keep]


class Rows:
    """Rows of a task, settled among themselves before they leave it."""

    def __init__(self, settle, limit: int = CHUNK_ROWS) -> None:
        self.settle, self.limit = settle, limit
        self.parts: list[dict[str, np.ndarray]] = []
        self.size = 0

    def add(self, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append(columns)
        self.size += len(columns["doc"])
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            rows = {k: np.concatenate([p[k] for p in self.parts]) for k in self.parts[0]}
            self.parts, self.size = [], 0
            yield self.settle(rows)


def settle_spans(rows: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    rows, new = _settled(rows, "digit", "span", "doc", "tag", "pos")
    flag = np.where(new, OPEN, REPEAT)
    at = np.flatnonzero(new)
    at = at[np.argsort(rows["digit"][at], kind="stable")]
    digits = rows["digit"][at]
    start = np.searchsorted(digits, digits)
    crowded = np.searchsorted(digits, digits, "right") - start > SPANS_PER_DIGIT
    flag[at[crowded]] = CROWDED
    rows["flag"] = flag
    # Two witnesses with different spans show every other task that the bucket is shared.
    sent = at[crowded & (np.arange(len(at)) - start < 2)]
    witness = {k: v[sent] for k, v in rows.items()}
    witness["flag"] = np.full(len(sent), WITNESS)
    rows = {k: np.concatenate([v, witness[k]]) for k, v in rows.items()}
    # What is settled travels anywhere, not to the bucket of a frequent digit.
    passing = np.isin(rows["flag"], (REPEAT, CROWDED))
    spread = texts.mix((rows["digit"] ^ rows["pos"] ^ (rows["doc"] << 20)).view(np.uint64)) & FULL
    digit = np.where(passing, spread, rows["digit"].view(np.uint64))
    span = rows["span"].view(np.uint64)
    bucket = (digit % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    present, first = np.unique(bucket[order], return_index=True)
    offsets = pa.array(np.append(first, len(order)), pa.int32())
    rows["high"] = _low_half(digit >> np.uint64(32) << np.uint64(16) | span >> np.uint64(32))
    rows["digit"], rows["span"] = _low_half(digit), _low_half(span)
    columns = [
        pa.ListArray.from_arrays(offsets, pa.array(rows[name][order]).cast(kind))
        for name, kind in SPAN_COLUMNS.items()
    ]
    return pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), *columns], ["bucket", *SPAN_COLUMNS])


def _low_half(values: np.ndarray) -> np.ndarray:
    return (values & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def settle_windows(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Runs of neighbouring windows: open ones of a span with their fingerprints, and
    known repeats without."""
    rows, new = _settled(rows, "key", "print", "doc", "tag", "low")
    open_ = new & ~rows["repeat"]
    cut = np.ones(len(open_) + 1, bool)
    same = rows["low"][1:] == rows["high"][:-1] + 1
    for column in ("doc", "tag"):
        same &= rows[column][1:] == rows[column][:-1]
    both_open = open_[1:] & open_[:-1] & (rows["span"][1:] == rows["span"][:-1]) & ~rows["crowded"][1:]
    cut[1:-1] = ~(same & (both_open | ~open_[1:] & ~open_[:-1]))
    first = np.flatnonzero(cut[:-1])
    last = np.flatnonzero(cut[1:])
    is_open = open_[first]
    lengths = np.where(is_open, last - first + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    key, doc, tag = rows["key"][first], rows["doc"][first], rows["tag"][first]
    crowded = rows["crowded"][first]
    alone = texts.mix(rows["print"][first].view(np.uint64) ^ key.view(np.uint64))
    key = np.where(is_open & ~crowded, key, texts.signed(alone))
    prints = rows["print"][open_].view(np.uint64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key),
            pa.array(doc),
            pa.array(tag),
            pa.array(rows["low"][first].astype(np.int32)),
            pa.array(rows["high"][last].astype(np.int32)),
            pa.ListArray.from_arrays(offsets, pa.array(_low_half(prints))),
            pa.ListArray.from_arrays(
                offsets, pa.array((prints >> np.uint64(48)).astype(np.uint16).view(np.int16))
            ),
        ],
        schema=DEEP,
    )


def _span_map(window: int, buckets: int):
    digit = digit_of(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(lambda r: settle_spans(r, buckets))
        for batch in batches:
            ids = texts.numbers(batch.column(0))
            for block in texts.blocks(batch.column(1), BLOCK_BYTES):
                place, low, high = synchronised(block, window, digit)
                row = np.searchsorted(block.offsets, place, "right") - 1
                base = block.offsets[row]
                span = texts.ranges(block.sums(1), low, high + window)
                span ^= texts.mix((place - low).astype(np.uint64))
                yield from rows.add(
                    digit=texts.signed(texts.ranges(block.sums(), place, place + digit) & FULL),
                    span=texts.signed(span & FULL),
                    doc=ids[block.first + row],
                    tag=block.tags()[row],
                    pos=place - base,
                )
        yield from rows.flush()

    return run


def _deep_map(window: int):
    digit = digit_of(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(settle_windows)
        for batch in batches:
            ids = texts.numbers(batch.column(0))
            offsets, spans = texts.lists_of(batch.column(2))
            for block in texts.blocks(batch.column(1), BLOCK_BYTES):
                doc, tag = ids[block.first : block.first + block.rows], block.tags()
                own = spans[offsets[block.first] : offsets[block.first + block.rows]]
                row = texts.rows_of(offsets[block.first : block.first + block.rows + 1])
                place, low, high = synchronised(block, window, digit)
                # Spans are named by their place; those of another text of this id are not here.
                asked = block.offsets[row] + ((own >> 2) & 0x7FFFFFFF)
                at = np.minimum(np.searchsorted(place, asked), max(len(place) - 1, 0))
                mine = (own >> 33 & 0x7FFFFFFF) == tag[row]
                mine &= (place[at] == asked) if len(place) else False
                order = np.flatnonzero(mine)[np.argsort(asked[mine])]
                row, at, flag = row[order], at[order], (own[order] & 3) + REPEAT
                base = block.offsets[row]
                pos, low, high = place[at] - base, low[at] - base, high[at] - base
                key = texts.ranges(block.sums(), base + pos, base + pos + digit)
                # A repeated span is one window here, with its last window beside it.
                count = np.where(flag == REPEAT, 1, high - low + 1)
                of = np.repeat(np.arange(len(row)), count)
                start = low[of] + np.arange(len(of)) - (np.cumsum(count) - count)[of]
                repeat = flag[of] == REPEAT
                begin = base[of] + start
                prints = texts.ranges(block.sums(1), begin, begin + window)
                yield from rows.add(
                    key=texts.signed(np.where(repeat, texts.mix(of.astype(np.uint64)), key[of])),
                    print=texts.signed(prints),
                    doc=doc[row[of]],
                    tag=tag[row[of]],
                    low=start,
                    high=np.where(repeat, high[of], start),
                    span=of,
                    repeat=repeat,
                    crowded=flag[of] == CROWDED,
                )
        yield from rows.flush()

    return run


def _apply_map(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, runs, kept = [], [], [], []
            gone = batch.column(2).to_pylist()
            for block in texts.blocks(batch.column(1), BLOCK_BYTES):
                tags = block.tags()
                for row in range(block.rows):
                    data = block.data[block.offsets[row] : block.offsets[row + 1]]
                    total.append(len(data))
                    own = [g for g in gone[block.first + row] or () if g["tag"] == tags[row]]
                    if not own:
                        removed.append(0)
                        runs.append(0)
                        kept.append(data.tobytes())
                        continue
                    edges = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edges, [g["low"] for g in own], 1)
                    np.add.at(edges, [g["high"] + window for g in own], -1)
                    cut = np.cumsum(edges)[:-1] > 0
                    removed.append(int(cut.sum()))
                    runs.append(int((cut & ~np.r_[False, cut[:-1]]).sum()))
                    kept.append(data[~cut].tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc": batch.column(0),
                    "n_bytes": pa.array(total, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "n_spans": pa.array(runs, pa.int64()),
                    "kept": pa.array(kept, pa.binary()),
                }
            )

    return run


def tied_spans(spans: DataFrame) -> DataFrame:
    """Passes 1 and 2: per document the spans that repeat or go deeper."""
    flag = F.col("flag")
    passing = flag.isin(REPEAT, CROWDED)
    columns = F.inline(F.arrays_zip(*SPAN_COLUMNS))
    bucket = Window.partitionBy("bucket", "digit")
    ordered = bucket.orderBy("span", F.when(flag == OPEN, 0).otherwise(1), "doc", "tag", "pos")
    here = F.struct("doc", "tag", "pos")
    quarter = lambda c: F.shiftleft(c.cast("long"), 32)
    digit = quarter(F.shiftrightunsigned("high", 16)).bitwiseOR(F.col("digit").bitwiseAND(F.lit(0xFFFFFFFF)))
    span = quarter(F.col("high").bitwiseAND(F.lit(0xFFFF))).bitwiseOR(F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)))
    rows = spans.repartition("bucket").select("bucket", columns)
    found = rows.withColumns({"digit": digit, "span": span}).withColumns(
        {
            "_span": F.lag("span").over(ordered),
            "_here": F.lag(here).over(ordered),
            "_least": F.min("span").over(bucket),
            "_most": F.max("span").over(bucket),
            "_crowded": F.max(flag == WITNESS).over(bucket),
        }
    )
    state = (
        F.when(passing, flag)
        .when(flag == WITNESS, F.lit(None))
        .when((F.col("_span") == F.col("span")) & (F.col("_here") == here), F.lit(None))
        .when(F.col("_span") == F.col("span"), F.lit(REPEAT))
        .when(F.col("_crowded"), F.lit(CROWDED))
        .when(F.col("_least") != F.col("_most"), F.lit(DEEPER))
    )
    found = found.withColumn("state", state.cast("long")).where("state IS NOT NULL")
    # Tag, place and state of a span in one number.
    packed = F.shiftleft(F.col("tag").cast("long"), 33).bitwiseOR(F.shiftleft(F.col("pos").cast("long"), 2))
    return found.groupBy("doc").agg(F.collect_list(packed.bitwiseOR(F.col("state") - REPEAT)).alias("spans"))


def repeated_windows(deep: DataFrame) -> DataFrame:
    """Pass 3: per document the windows, or runs of windows, that stand earlier too."""
    known = F.size("prints") == 0
    windows = deep.repartition("key").select(
        "key", "doc", "tag", "low", "high", known.alias("known"),
        F.posexplode_outer(F.arrays_zip("prints", "more")).alias("at", "print"),
    )
    low = F.when(F.col("known"), F.col("low")).otherwise(F.col("low") + F.col("at"))
    high = F.when(F.col("known"), F.col("high")).otherwise(low)
    windows = windows.select("key", "print", "doc", "tag", low.alias("low"), high.alias("high"), "known")
    here = F.struct("doc", "tag", "low")
    group = Window.partitionBy("key", "print").orderBy("doc", "tag", "low")
    found = windows.withColumn("_first", F.first(here).over(group))
    found = found.where(F.col("known") | (F.col("_first") != here))
    return found.groupBy("doc").agg(F.collect_list(F.struct("tag", "low", "high")).alias("gone"))


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans and the bytes kept.

    A byte goes if a string of ``window`` bytes that covers it also starts earlier: in a
    smaller document, or before it in the same one.
    """
    rows = tables.keyed(docs)
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = tied_spans(rows.mapInArrow(_span_map(window, buckets), SPAN_FIELDS))
    tied = rows.join(spans, "doc").select("doc", "text", "spans")
    gone = repeated_windows(tied.mapInArrow(_deep_map(window), DEEP_FIELDS))
    applied = rows.join(gone, "doc", "left").select("doc", "text", "gone")
    out = applied.mapInArrow(
        _apply_map(window), "doc long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
    return out.select(tables.doc_id(), "n_bytes", "n_removed", "n_spans", "kept")


def query(spark, folder: str) -> DataFrame:
    out = without_repeats(tables.read(spark, folder, "documents"))
    return out.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
