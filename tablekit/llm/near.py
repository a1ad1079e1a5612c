"""Near duplicates by one-permutation MinHash with optimal densification.

1. A document's set is its distinct shingles of words. Documents with equal sets are one
   class; its smallest document stands for it from here on.
2. One hash of every shingle fills ``BANDS * ROWS`` bins with their minima. An empty bin
   takes the value of another, by a fixed sequence of random bins that is the same for
   all documents. Neighbouring bins form bands; documents with an equal band share a
   bucket.
3. Each bucket gives star-shaped edges: one centre against all others. The centre is the
   member that meets most others in all its buckets, as an original does among its
   copies. Edges are confirmed on full sets: first each document's edge to the centre it
   shares most buckets with, then those whose ends have not been joined by these.
4. In buckets whose members are not all joined then, all pairs of unlike components are
   compared by odd sketches, a bit for the parity of the shingles in each of some parts.
   Sets differ in at least as many shingles as their sketches do in bits, so pairs that
   differ in too many are not similar, and no set travels for them. The others are
   confirmed on full sets: first the nearest of each node in each other component, then
   all that are not joined by these. So a bucket of copies costs one star, and no pair
   that shares a bucket is left out, unless both are known to be joined already. Pairs
   are compared inside the tasks, by blocks of ``BLOCK`` members of a bucket.
5. Components follow from the confirmed edges, and give every document its class.

Two documents at the threshold of 0.8 share no bucket with a chance of
(1 - 0.8**5)**40, about 1e-7.

Null texts are empty. Documents without words have an empty set and are linked with
nothing, not even with each other. A null id sorts before all others; rows that share an
id are one document with several texts, each with a row of its own, all linked through
the id. ``without_duplicates`` does not link through the id: there each row is a document
by itself. Other columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.llm import tables, texts
from tablekit.llm.components import components

SHINGLE = 4
PERCENT = 80
BANDS, ROWS = 40, 5
BINS = BANDS * ROWS

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

SIGNED = "doc long, n_shingles long, set1 long, set2 long, bands array<long>"
EMPTY_BIN = np.uint64(2**64 - 1)


def shingle_sets(block: texts.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of every row's shingles, and each row's first."""
    lower = texts.Block(block.first, LOWER[block.data], block.offsets)
    starts, ends, first = lower.words()
    words = texts.ranges(lower.sums(), starts, ends)
    sums = texts.prefix_sums(words)
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(block.rows), count)
    begin = first[row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
    prints = texts.ranges(sums, begin, np.minimum(begin + size, first[row + 1]))
    order = np.lexsort((prints, row))
    row, prints = row[order], prints[order]
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (prints[1:] != prints[:-1])
    row, prints = row[new], prints[new]
    return prints, np.searchsorted(row, np.arange(block.rows + 1))


def densified(prints: np.ndarray, first: np.ndarray, bins: int) -> np.ndarray:
    """Signatures, a row each; rows without shingles keep empty bins."""
    rows = len(first) - 1
    out = np.full((rows, bins), EMPTY_BIN)
    row = texts.rows_of(first)
    # Bins are ranges of the fingerprint, so in sorted sets each bin's minimum is its first.
    place = ((prints >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    new = np.ones(len(row), bool)
    new[1:] = (np.diff(row) != 0) | (np.diff(place) != 0)
    out[row[new], place[new]] = prints[new]
    filled = out != EMPTY_BIN
    todo_row, todo_bin = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(todo_row):
        attempt += 1
        seed = np.uint64((attempt * 0x9E3779B97F4A7C15) % 2**64)
        source = (texts.mix(todo_bin.astype(np.uint64) + seed) % np.uint64(bins)).astype(np.int64)
        found = filled[todo_row, source]
        out[todo_row[found], todo_bin[found]] = out[todo_row[found], source[found]]
        todo_row, todo_bin = todo_row[~found], todo_bin[~found]
    return out


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in texts.blocks(batch.column(1), BLOCK_BYTES):
                prints, first = shingle_sets(block, size)
                other = texts.prefix_sums(texts.mix(prints ^ np.uint64(0x5851F42D4C957F2D)), 1)
                signature = densified(prints, first, BINS)
                value = np.zeros((block.rows, BANDS), np.uint64)
                for k in range(ROWS):
                    value = texts.mix(value * np.uint64(3) + signature[:, k::ROWS][:, :BANDS])
                value = texts.mix(value + np.arange(BANDS, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.rows),
                        pa.array(np.diff(first)),
                        pa.array(texts.signed(texts.ranges(texts.prefix_sums(prints), first[:-1], first[1:]))),
                        pa.array(texts.signed(texts.ranges(other, first[:-1], first[1:]))),
                        pa.ListArray.from_arrays(
                            np.arange(block.rows + 1, dtype=np.int32) * BANDS, pa.array(texts.signed(value.ravel()))
                        ),
                    ],
                    ["doc", "n_shingles", "set1", "set2", "bands"],
                )

    return run


def _short(prints: np.ndarray) -> bytes:
    """The upper 48 bits of each fingerprint, enough to tell two sets' members apart."""
    return prints.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(members: bytes) -> np.ndarray:
    wide = np.zeros((len(members) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(members, np.uint8).reshape(-1, 6)
    return wide.view(">u8").ravel().astype(np.uint64)


SETS = "center long, lot int, member int, node long, prints binary"
LOT = 500
BLOCK_BYTES = 1 << 19
MAX_BROADCAST_ENDS = 200_000
# More than ends, as these are single numbers.
MAX_BROADCAST_KEYS = 2_000_000


def _sets(size: int):
    """The sets of edges' ends, each beside its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in texts.blocks(batch.column(4), BLOCK_BYTES):
                prints, first = shingle_sets(block, size)
                own = [c.slice(block.first, block.rows) for c in batch.columns[:4]]
                sets = [_short(prints[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(sets, pa.binary())], ["center", "lot", "member", "node", "prints"]
                )

    return run


def _confirmed(percent: int):
    """Links of each lot, whose centre comes before its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, centers = None, []
        for batch in batches:
            links: list[tuple[int, int]] = []
            for center, lot, member, node, prints in zip(*batch.columns, strict=True):
                center, lot, own = center.as_py(), lot.as_py(), _long(prints.as_py())
                if (center, lot) != current:
                    current, centers = (center, lot), []
                if not member.as_py():
                    centers.append(own)
                    continue
                for other in centers:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        links.append((center, node.as_py()))
                        break
            ends = (pa.array([x[k] for x in links], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*ends], ["a", "b"])

    return run


def _stars(live: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Centres of the buckets, and the edges (a, b, shared) of their stars: the centre, the
    other end, and in how many buckets they meet.

    A bucket's centre is the node that meets most others, counted over all its buckets. Copies
    of one text are nearer to it than to each other, so it is the one that they share most
    buckets with, and most of its edges hold. Sizes that rule the threshold out, and ends
    that are one already, give no edge.
    """
    met = live.groupBy("node").agg(F.sum("others").alias("met"))
    ranked = live.join(_small(met, "met"), "node")
    first = F.max(F.struct("met", -F.col("node"), "node", "n", "component")).alias("c")
    centers = ranked.groupBy("bucket").agg(first).select("bucket", "c.node", "c.n", "c.component", "c.met")
    n, c = F.col("l.n"), F.col("c.n")
    fits = (n * 100 >= c * percent) & (c * 100 >= n * percent)
    apart = F.col("l.component") != F.col("c.component")
    edges = live.alias("l").join(centers.alias("c"), "bucket").where(fits & apart)
    low, high = F.least("l.node", "c.node").alias("low"), F.greatest("l.node", "c.node").alias("high")
    center = F.max(F.struct("c.met", F.col("c.node").alias("node")))["node"].alias("a")
    edges = edges.groupBy(low, high).agg(F.count(F.lit(1)).alias("shared"), center)
    b = F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    return centers.select("bucket", "node"), edges.select("a", b.alias("b"), "shared")


def _with_components(df: DataFrame, node: str, joined: DataFrame | None, name: str = "component") -> DataFrame:
    if joined is None:
        return df.withColumn(name, F.col(node))
    known = joined.select(F.col("doc").alias(node), F.col("component").alias("_known"))
    return df.join(known, node, "left").withColumn(name, F.coalesce("_known", node)).drop("_known")


def _confirm(rows: DataFrame, edges: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those edges (a, b) whose full sets are similar.

    The sets travel once, to the centre ``a``. A centre with many members is split into
    lots of about ``LOT`` of them, each with a copy of the centre's set.
    """
    sizes = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("a", F.ceil(F.col("n") / LOT).cast("int").alias("lots"))
    lot = F.pmod(F.xxhash64("b"), F.col("lots")).cast("int")
    members = edges.join(sizes, "a").select(F.col("a").alias("center"), lot.alias("lot"), F.lit(1).alias("member"), F.col("b").alias("doc"))
    lots = F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot")
    centers = sizes.select(F.col("a").alias("center"), lots, F.lit(0).alias("member"), F.col("a").alias("doc"))
    ends = _small(members.unionByName(centers), "ends")
    asked = rows.join(ends, "doc").select("center", "lot", "member", "doc", "text")
    sets = asked.mapInArrow(_sets(shingle), SETS)
    dealt = sets.repartition("center", "lot").sortWithinPartitions("center", "lot", "member")
    return dealt.mapInArrow(_confirmed(percent), "a long, b long").distinct()


def _small(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a written table, to be broadcast where counting shows that they are few."""
    df, seen = tables.staged_counting(df, purpose, n=F.count(F.lit(1)))
    return F.broadcast(df) if seen["n"] <= MAX_BROADCAST_ENDS else df


def _chosen(rows: DataFrame, keys: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of the ``chosen`` ones among ``keys``, which has every ``_key`` of the rows.

    The chosen keys or the others, whichever are fewer, are broadcast, so texts are not
    shuffled. Only where both are more than ``MAX_BROADCAST_KEYS``, all rows are, once.
    """
    marked = keys.join(chosen.withColumn("_in", F.lit(True)), "_key", "left")
    counts = {"chosen": F.count_if("chosen"), "others": F.count_if(~F.col("chosen"))}
    marked, seen = tables.staged_counting(marked.select("_key", F.col("_in").isNotNull().alias("chosen")), "chosen", **counts)
    inside, outside = (marked.where(c).select("_key") for c in (F.col("chosen"), ~F.col("chosen")))
    if min(seen.values()) > MAX_BROADCAST_KEYS:
        return rows.join(inside, "_key", "left_semi")
    if seen["others"] < seen["chosen"]:
        return rows.join(F.broadcast(outside), "_key", "left_anti")
    return rows.join(F.broadcast(inside), "_key", "left_semi")


def _candidates(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Texts of documents that share a bucket, written once for all turns."""
    nodes = _small(live.select(F.col("node").alias("doc")).distinct(), "nodes")
    return tables.staged(rows.join(nodes, "doc", "left_semi"), "candidates")


# Bits of the longest sketch; members of a bucket that a task holds on either side.
MOST_BITS = 1 << 14
BLOCK = 4096

SKETCHES = "node long, n long, odd binary"


def odd_sketches(prints: np.ndarray, first: np.ndarray) -> pa.Array:
    """Per row the parities of its shingles in 64 parts or more, at least two parts a shingle."""
    n = np.diff(first)
    level = np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64)
    bits = 1 << np.clip(level, 6, MOST_BITS.bit_length() - 1)
    end = np.cumsum(bits)
    row = texts.rows_of(first)
    at = (end - bits)[row] + (prints & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(end[-1]) if len(end) else 0) & 1
    data = np.packbits(odd.astype(np.uint8), bitorder="little")
    offsets = np.concatenate([[0], end // 8]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _sketched(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in texts.blocks(batch.column(1), BLOCK_BYTES):
                prints, first = shingle_sets(block, size)
                own = batch.column(0).slice(block.first, block.rows)
                columns = [own, pa.array(np.diff(first)), odd_sketches(prints, first)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "odd"])

    return run


def _folded(odd: np.ndarray, words: int) -> np.ndarray:
    """Sketches of fewer parts, from those of more."""
    while odd.shape[1] > words:
        half = odd.shape[1] // 2
        odd = odd[:, :half] ^ odd[:, half:]
    return odd


def plausible(
    side: np.ndarray, component: np.ndarray, n: np.ndarray, odd: list[bytes], percent: int, best: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of a bucket that may be similar, of unlike components.

    Where members are of two sides, pairs are of one and the other. With ``best``, only the
    nearest one to each member in each other component.
    """
    words = np.array([len(o) // 8 for o in odd])
    order = np.argsort(words, kind="stable")
    side, component, n, words = side[order], component[order], n[order], words[order]
    both_sides = bool(side.min() != side.max())
    out_a, out_b = [], []
    # A member's partners have sketches as long as its own, or longer ones, which are folded.
    for width in np.unique(words):
        start = int(np.searchsorted(words, width))
        some = [np.frombuffer(odd[k], np.uint64).reshape(1, -1) for k in order[start:]]
        folded = np.concatenate([_folded(o, width) for o in some])
        for i in range(start, int(np.searchsorted(words, width, "right"))):
            rest = slice(i + 1, None)
            fits = (component[rest] != component[i]) & (n[rest] * 100 >= n[i] * percent) & (n[i] * 100 >= n[rest] * percent)
            if both_sides:
                fits &= side[rest] != side[i]
            j = np.flatnonzero(fits) + i + 1
            apart = np.bitwise_count(folded[j - start] ^ folded[i - start]).sum(axis=1, dtype=np.int64)
            near_ = apart * (100 + percent) <= (n[j] + n[i]) * (100 - percent)
            j, apart = j[near_], apart[near_]
            if best and len(j) > 1:
                j = j[np.argsort(apart, kind="stable")]
                j = j[np.unique(component[j], return_index=True)[1]]
            out_a.append(np.full(len(j), i))
            out_b.append(j)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return order[a], order[b]


def _compared(percent: int, best: bool):
    """Plausible pairs of each block, of rows that come sorted by bucket and block."""

    def pairs(group: pa.Table) -> Iterator[pa.RecordBatch]:
        side, node, component, n = (texts.numbers(group[c].combine_chunks()) for c in ("side", "node", "component", "n"))
        if component.min() == component.max():
            return
        a, b = plausible(side, component, n, group["odd"].to_pylist(), percent, best)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = np.array([texts.numbers(held[c].combine_chunks()) for c in ("bucket", "low", "high")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            begin = 0
            for cut in cuts.tolist():
                yield from pairs(held.slice(begin, cut - begin))
                begin = cut
            held = held.slice(begin)
        if held is not None and held.num_rows:
            yield from pairs(held)

    return run


def _plausible(live: DataFrame, sketches: DataFrame, percent: int, best: bool, block: int) -> DataFrame:
    """Pairs (a, b) that share a bucket, are of unlike components and may be similar."""
    blocks = F.ceil(F.col("others") / block).cast("int")
    own = F.when(blocks > 1, F.pmod(F.xxhash64("node"), blocks)).otherwise(0).cast("int")
    placed = live.select("bucket", "node", "component", own.alias("side"), blocks.alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("*", other).select(
        "bucket", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "component"
    )
    rows = dealt.join(sketches, "node").where("n > 0")
    rows = rows.select("bucket", "low", "high", "side", "node", "component", "n", "odd")
    rows = rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    found = rows.mapInArrow(_compared(percent, best), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    same = (F.least("a", "b") == F.col("low")) & (F.greatest("a", "b") == F.col("high"))
    return pairs.join(tested, same, "left_anti")


def _unjoined(members: DataFrame, joined: DataFrame | None) -> tuple[DataFrame, int]:
    """Members of buckets that hold unlike components, with the number of members; and how many."""
    live = _with_components(members, "node", joined)
    ends = F.min("component").alias("low"), F.max("component").alias("high")
    span = live.groupBy("bucket").agg(*ends, F.count(F.lit(1)).alias("others"))
    live = live.join(span.where("low <> high").select("bucket", "others"), "bucket")
    live, seen = tables.staged_counting(live, "buckets", n=F.count(F.lit(1)))
    return live, seen["n"]


def _joined_more(
    rows: DataFrame, edges: DataFrame, joined: DataFrame | None, shingle: int, percent: int
) -> DataFrame | None:
    """Components with those of ``edges`` that hold."""
    confirmed = _confirm(rows, edges.select("a", "b"), shingle, percent)
    found, new = tables.staged_counting(confirmed, "links", n=F.count(F.lit(1)))
    if new["n"]:
        # What joined ends so far stands for all links before.
        links = found if joined is None else found.unionByName(_as_edges(joined))
        last, joined = joined, components(links)
        tables.dropped(last)
    tables.dropped(found)
    return joined


def confirmed_links(
    rows: DataFrame, members: DataFrame, shingle: int, percent: int, block: int = BLOCK
) -> DataFrame | None:
    """Components (doc, component) of all nodes that share a bucket with a similar one.

    Tables of a step are dropped when the next ones are written.
    """
    live, n = _unjoined(members, None)
    if not n:
        return None
    rows = _candidates(rows, live)
    centers, pending = _stars(live, percent)
    pending, seen = tables.staged_counting(pending, "pending", n=F.count(F.lit(1)))
    # First the best edge of each document; most ends are joined then, and the rest follows.
    best = F.max(F.struct("shared", "a"))["a"].alias("a")
    first = tables.staged(pending.groupBy("b").agg(best).select("a", "b"), "edges")
    tested = first
    joined = _joined_more(rows, first, None, shingle, percent) if seen["n"] else None
    left = pending.join(first, ["a", "b"], "left_anti")
    left = _with_components(_with_components(left, "a", joined, "ca"), "b", joined, "cb")
    left = left.where("ca <> cb").select("a", "b")
    left, seen = tables.staged_counting(left, "pending", n=F.count(F.lit(1)))
    tables.dropped(pending)
    if seen["n"]:
        tested = tested.unionByName(left)
        joined = _joined_more(rows, left, joined, shingle, percent)
    # A centre has met all others of its bucket.
    members = live.join(centers, ["bucket", "node"], "left_anti").select("bucket", "node", "n")
    sketches = None
    for nearest in (True, False):
        before = live
        live, n = _unjoined(members, joined)
        if not n:
            break
        if sketches is None:
            nodes = _small(live.select(F.col("node").alias("doc")).distinct(), "nodes")
            asked = rows.join(nodes, "doc", "left_semi").select("doc", "text")
            sketches = tables.staged(asked.mapInArrow(_sketched(shingle), SKETCHES), "sketches")
        members = live.select("bucket", "node", "n")
        pairs = _untested(
            _plausible(live, sketches, percent, nearest, block),
            tested.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")),
        )
        pairs, seen = tables.staged_counting(pairs, "pending", n=F.count(F.lit(1)))
        tables.dropped(before)
        if not seen["n"]:
            # The nearest may have been tested before, and others not.
            continue
        tested = tested.unionByName(pairs)
        joined = _joined_more(rows, pairs, joined, shingle, percent)
    tables.dropped(rows)
    return joined


def _as_edges(joined: DataFrame) -> DataFrame:
    return joined.select(F.col("component").alias("a"), F.col("doc").alias("b"))


def _signed(rows: DataFrame, shingle: int) -> DataFrame:
    tables.lean(rows.sparkSession)
    return tables.staged(rows.mapInArrow(_signatures(shingle), SIGNED), "signatures")


def _alike(rows: DataFrame, signed: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Per row (doc, text): doc, n_shingles and node, the smallest document with an equal
    set; and the components (doc, component) of nodes that are similar to others."""
    some = signed.where("n_shingles > 0")
    smallest = F.min_by(F.struct("n_shingles", "bands"), "doc").alias("x")
    classes = tables.staged(
        some.groupBy("set1", "set2").agg(F.min("doc").alias("node"), smallest).select("set1", "set2", "node", "x.*"),
        "classes",
    )
    members = classes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    joined = confirmed_links(rows, members.select("bucket", "node", "n"), shingle, percent)
    owned = signed.select("doc", "n_shingles", "set1", "set2").join(
        classes.select("set1", "set2", "node"), ["set1", "set2"], "left"
    )
    return owned.select("doc", "n_shingles", F.coalesce("node", "doc").alias("node")), joined


def linked(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc, n_shingles and component, the smallest linked document."""
    rows = tables.keyed(docs)
    owned, joined = _alike(rows, _signed(rows, shingle), shingle, percent)
    # Texts of one id in unlike classes link these classes.
    several = owned.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    if not several.isEmpty():
        bridges = owned.join(several.select("doc", "a"), "doc").select("a", F.col("node").alias("b"))
        if joined is not None:
            bridges = bridges.unionByName(joined.select(F.col("component").alias("a"), F.col("doc").alias("b")))
        joined = components(bridges)
    return _with_components(owned, "node", joined).select("doc", "n_shingles", "component")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and whether the document is kept."""
    out = linked(docs, shingle, percent)
    kept = F.col("doc") == F.col("component")
    return out.select(
        tables.doc_id(), F.col("n_shingles").cast("long").alias("n_shingles"),
        tables.doc_id("component").alias("component_id"), kept.alias("kept"),
    )


def without_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near duplicates in ``docs``: that of its smallest id, and of
    several rows with that id the one with the smallest text. Rows are linked by similarity
    only, whatever ids they share, so rows without words all stay."""
    row = tables.whole_row(docs).alias("_row")
    number, text = F.coalesce(docs["doc_id"].cast("long"), F.lit(tables.NULL_ID)), F.coalesce(docs["text"], F.lit(""))
    seed, clash = 0, True
    while clash:
        rows = docs.select(row, number.alias("_id"), F.xxhash64(F.lit(seed), number, text).alias("_key"))
        keyed = rows.select(F.col("_key").alias("doc"), F.coalesce("_row.text", F.lit("")).alias("text"))
        signed = _signed(keyed, shingle)
        one = F.struct("set1", "set2")
        sets = signed.groupBy("doc").agg(F.min(one).alias("low"), F.max(one).alias("high"))
        # Keys that unlike sets share are drawn anew.
        seed, clash = seed + 1, not sets.where("low <> high").isEmpty()
    ids = rows.groupBy("_key").agg(F.min("_id").alias("id"), F.count(F.lit(1)).alias("n"))
    ids, seen = tables.staged_counting(ids.withColumnRenamed("_key", "doc"), "ids", repeats=F.count_if(F.col("n") > 1))
    if seen["repeats"]:
        keyed = keyed.dropDuplicates(["doc"])
    owned, joined = _alike(keyed, signed, shingle, percent)
    owned = _with_components(owned, "node", joined).select("doc", "n_shingles", "component").distinct()
    grouped = tables.staged(owned.join(ids, "doc"), "grouped")
    least = F.min(F.struct("doc", "n", "n_shingles")).alias("x")
    counted = grouped.groupBy("component", "id").agg(F.count(F.lit(1)).alias("keys"), least)
    lowest = counted.groupBy("component").agg(F.min(F.struct("id", "keys", "x")).alias("y")).select("component", "y.*")
    lowest = tables.staged(lowest, "lowest")
    kept = lowest.where("keys = 1").select(F.col("x.doc").alias("_key"), "x.n", "x.n_shingles")
    several = lowest.where("keys > 1").select("component", "id")
    if not several.isEmpty():
        tied = grouped.join(_small(several, "several"), ["component", "id"])
        tied = tied.select("component", F.col("doc").alias("_key"), "n", "n_shingles")
        said = rows.select("_key", F.col("_row.text").alias("text")).join(tied, "_key")
        first = said.groupBy("component").agg(F.min(F.struct("text", "_key", "n", "n_shingles")).alias("x"))
        kept = kept.unionByName(first.select("x._key", "x.n", "x.n_shingles"))
    every = F.col("n_shingles") == 0
    single = kept.where((F.col("n") == 1) | every).select("_key")
    out = _chosen(rows, grouped.select(F.col("doc").alias("_key")), single).select("_row")
    if seen["repeats"]:
        copies = rows.join(_small(kept.where((F.col("n") > 1) & ~every).select("_key"), "copies"), "_key")
        copies = copies.groupBy("_key").agg(F.min_by("_row", F.struct("_id", "_row.text")).alias("_row"))
        out = out.unionByName(copies.select("_row"))
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def query(spark, folder: str) -> DataFrame:
    return near_duplicates(tables.read(spark, folder, "documents"))
