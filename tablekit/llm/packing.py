"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenised, ended by an end id, cut where longer than a sequence, and
packed into sequences of ``capacity`` ids without a gap. Full pieces fill a sequence
alone. The others are dealt out evenly into *provinces* of a bounded number of pieces,
each of which is packed by several *islands*: populations of packings, each bred in a
task of its own. Crossover injects the fullest bins of one parent whole into the other,
drops the bins that hold duplicates of injected pieces, and places the pieces so set
free by best fit, largest first. After each epoch an island's elite migrates to the next
island of its province, by a shuffle of the elite packings alone; in the end the best
packing of each province is kept. Pieces of bins that stay loosely filled are pooled and
packed once more, so that provinces don't each leave a bin half empty.

The work per piece is constant, whatever the number of documents, and a task holds one
province. All choices follow from seeds, so a task that is run again gives the same.

Null texts are empty; an empty document is its end id. A null id is carried as it is.
Rows that share an id, or are equal, are packed one by one. Other columns are not looked at. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import os
import sys
import types
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablekit.llm import tables, texts

CAPACITY = 2048
END_ID = 0
PROVINCE_PIECES = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 8
GENERATIONS = 100
PATIENCE = 25
LONG_CHUNK = 256
CACHE_WORDS = 400_000
CACHE_IDS = 4_000_000
BLOCK_BYTES = 1 << 20
RUN_BYTES = 1 << 16

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
LOOSE_FILL = 0.97


# ------------------------------------------------------------------ tokens


def _state() -> types.ModuleType:
    """What a Python worker keeps from task to task: tokenizer and known chunks."""
    return sys.modules.setdefault("_packing_state", types.ModuleType("_packing_state"))


class Tokens:
    """Ids of texts, each distinct chunk tokenised once.

    The pre-tokenizer never joins white space to what stands before it, so a text may be
    cut before any white space that follows something else, and the ids of the chunks
    are those of the text. Chunks are known by a 64-bit fingerprint, those longer than
    ``LONG_CHUNK`` bytes by a cryptographic one, as long texts that collide can be made; a
    worker forgets them all when there are too many.

    New chunks are tokenised in runs, one after the other as in a text. A byte-level token
    stands for as many bytes as it has letters, so the ids of each chunk are found by
    counting bytes. Where that does not come out, chunks are tokenised one by one.
    """

    def __init__(self, path: str) -> None:
        # Spark's tasks fill the cores; threads of the tokenizer would only wait for them.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.width[number] = len(token)
        for number, token in self.tokenizer.get_added_tokens_decoder().items():
            self.width[number] = len(token.content.encode())
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @staticmethod
    def cuts(block: texts.Block) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all chunks, every text's start among them; and which chunks may follow
        each other in any order, as they begin with white space and don't end with it."""
        data = block.data
        space = ~texts.NOT_SPACE[data]
        # Plain ASCII, or the second byte of a letter of two bytes, is no white space.
        solid = (data > 0x20) & (data < 0x7F)
        lead = (data >= 0xC3) & (data <= 0xDF)
        solid[1:] |= lead[:-1] & (data[1:] >= 0x80)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = space[1:] & solid[:-1]
        cut[block.offsets[:-1]] = True
        starts = np.flatnonzero(cut[:-1])
        last = np.append(starts, len(data))[1:] - 1
        return starts, space[starts] & solid[last]

    def _encoded(self, texts_: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts_, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _of_run(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks that ``data`` holds up to each of ``ends``, and their counts."""
        (ids,) = self._encoded([data.tobytes().decode("utf-8", "replace")])
        upto = np.cumsum(self.width[ids])
        at = np.searchsorted(upto, ends)
        if not len(ids) or upto[-1] != len(data) or (upto[at] != ends).any():
            begins = np.concatenate([[0], ends[:-1]])
            spans = zip(begins.tolist(), ends.tolist(), strict=True)
            parts = self._encoded([data[a:b].tobytes().decode("utf-8", "replace") for a, b in spans])
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, np.diff(at + 1, prepend=0)

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, free: np.ndarray) -> None:
        flat, counts = [], []
        # Chunks that stand at a text's end are tokenised alone, all others in runs.
        order = np.concatenate([np.flatnonzero(free), np.flatnonzero(~free)])
        keys, starts, lengths = keys[order], starts[order], (ends - starts)[order]
        upto = np.cumsum(lengths)
        run = (upto - lengths) // RUN_BYTES
        n_free = int(free.sum())
        first = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (np.arange(1, len(run)) >= n_free)])
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
            size = lengths[a:b]
            ends_ = np.cumsum(size)
            source = np.repeat(starts[a:b] - ends_ + size, size) + np.arange(ends_[-1])
            ids, count = self._of_run(data[source], ends_)
            flat.append(ids)
            counts.append(count)
        count = np.concatenate(counts)
        place = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, *flat])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.place = np.insert(self.place, at, place[order])
        self.count = np.insert(self.count, at, count[order])

    def of(self, block: texts.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the block's texts one after the other, and where each text's begin."""
        starts, free = self.cuts(block)
        ends = np.append(starts, len(block.data))[1:]
        keys = texts.ranges(block.quick_sums(), starts, ends)
        for i in np.flatnonzero(ends - starts > LONG_CHUNK):
            digest = hashlib.blake2b(block.data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
            keys[i] = np.frombuffer(digest, np.uint64)[0]
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS or len(self.ids) > CACHE_IDS:
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            chosen = first[new]
            self._learn(distinct[new], block.data, starts[chosen], ends[chosen], free[chosen])
            at = np.searchsorted(self.keys, distinct)
        place, count = self.place[at][inverse], self.count[at][inverse]
        total = np.cumsum(count)
        source = np.repeat(place - total + count, count) + np.arange(total[-1] if len(total) else 0)
        before = np.concatenate([[0], total])
        return self.ids[source], before[np.searchsorted(starts, block.offsets)]


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _state()
        tokens = state.__dict__.get(path)
        if tokens is None:
            tokens = state.__dict__[path] = Tokens(path)
        for batch in batches:
            doc = batch.column(0)
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for block in texts.blocks(batch.column(1), BLOCK_BYTES):
                ids, offsets = tokens.of(block)
                for row in range(block.rows):
                    own = np.append(ids[offsets[row] : offsets[row + 1]], np.uint32(END_ID)).astype("<u4")
                    first = len(own) % capacity or capacity
                    start, end, piece = 0, min(first, len(own)), 0
                    while start < len(own):
                        rows.append(block.first + row)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(end - start)
                        sums.append(zlib.crc32(own[start:end].tobytes()))
                        start, end, piece = end, end + capacity, piece + 1
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    doc.take(take),
                    pa.array(pieces, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                [field.split()[0] for field in PIECES.split(", ")],
            )

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length and the checksum of its ids."""
    tables.lean(docs.sparkSession)
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, capacity), PIECES)


# ------------------------------------------------------------- evolution

# A packing is an array that gives every piece of a province its bin.


def best_fit(lengths: np.ndarray, todo: list[int], bins: np.ndarray, capacity: int) -> np.ndarray:
    """Places pieces, largest first, each where the least room is left after it."""
    used = np.bincount(bins[bins >= 0], weights=lengths[bins >= 0]).astype(np.int64)
    rooms = sorted((capacity - int(u), b) for b, u in enumerate(used) if 0 < u < capacity)
    count = len(used)
    for piece in sorted(todo, key=lambda i: (-lengths[i], i)):
        size = int(lengths[piece])
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, chosen = rooms.pop(at)
        else:
            room, chosen, count = capacity, count, count + 1
        bins[piece] = chosen
        if room > size:
            insort(rooms, (room - size, chosen))
    return bins


def numbered(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins are better; of as many, those whose fill is more uneven."""
    fill = np.bincount(bins, weights=lengths) / capacity
    return -len(fill), float((fill * fill).sum())


def crossover(
    lengths: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int, rng: np.random.Generator
) -> np.ndarray:
    """The mother with some of the father's best filled bins in place of hers."""
    fill = np.bincount(father, weights=lengths)
    best = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    injected = np.zeros(len(fill), bool)
    injected[rng.choice(best, max(1, len(best) // 2), replace=False)] = True
    taken = injected[father]
    broken = np.zeros(int(mother.max()) + 1, bool)
    broken[mother[taken]] = True
    # A few of her emptiest bins are opened too, to give their pieces another chance.
    her_fill = np.bincount(mother, weights=lengths)
    broken[np.argsort(her_fill, kind="stable")[: max(1, len(her_fill) // 50)]] = True
    child = np.where(broken[mother], -1, mother)
    child[taken] = len(broken) + father[taken]
    kept = child >= 0
    child[kept] = numbered(child[kept])
    return numbered(best_fit(lengths, np.flatnonzero(~kept).tolist(), child, capacity))


def founders(lengths: np.ndarray, capacity: int, rng: np.random.Generator, n: int) -> list[np.ndarray]:
    """Best fit over all pieces, and over pieces of which some are placed at random first."""
    out = []
    for k in range(n):
        bins = np.full(len(lengths), -1, np.int64)
        if k and len(lengths) >= 8:
            early = rng.permutation(len(lengths))[: len(lengths) // 8]
            total = np.cumsum(lengths[early]) // capacity
            start = np.r_[True, total[1:] != total[:-1]]
            group = np.cumsum(start) - 1
            room = np.bincount(group, weights=lengths[early])
            fits = room[group] <= capacity
            bins[early[fits]] = numbered(group[fits]) if fits.any() else 0
        out.append(numbered(best_fit(lengths, np.flatnonzero(bins < 0).tolist(), bins, capacity)))
    return out


def evolve(lengths: np.ndarray, elite: list[np.ndarray], seed: int, capacity: int) -> np.ndarray:
    """One epoch of an island; the elite that arrived is part of its population.

    An epoch ends when no packing can have fewer bins, when ``PATIENCE`` children in turn
    were no better than the best packing, or after ``GENERATIONS``.
    """
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // capacity)
    population = [*elite, *founders(lengths, capacity, rng, max(1, POPULATION - len(elite)))]
    merits = [fitness(lengths, p, capacity) for p in population]
    best, idle = max(merits), 0
    for _ in range(GENERATIONS):
        ranked = sorted(range(len(population)), key=lambda k: merits[k], reverse=True)[:POPULATION]
        population, merits = [population[k] for k in ranked], [merits[k] for k in ranked]
        if population[0].max() + 1 <= least or len(population) < 2 or idle == PATIENCE:
            break
        i, j = rng.choice(len(population), 2, replace=False)
        child = crossover(lengths, population[min(i, j)], population[max(i, j)], capacity, rng)
        population.append(child)
        merits.append(fitness(lengths, child, capacity))
        best, idle = (merits[-1], 0) if merits[-1] > best else (best, idle + 1)
    return population[merits.index(max(merits))]


ISLAND = "province long, island int, n_bins int, spread double, lengths array<int>, bins array<int>, keys array<long>"


def _epoch(epoch: int, capacity: int):
    """Breeds every island once, given what arrived from its neighbour."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                lengths = np.asarray(r.lengths, np.int64)
                elite = [np.asarray(bins, np.int64) for bins in (r.bins, r.guest) if len(bins)]
                seed = (int(r.province) * 131 + int(r.island) * 17 + epoch) & 0x7FFFFFFF
                best = evolve(lengths, elite, seed, capacity)
                fit = fitness(lengths, best, capacity)
                out.append((r.province, r.island, -fit[0], fit[1], r.lengths, best.astype(np.int32), r.keys))
            if out:
                yield pd.DataFrame(out, columns=[f.split()[0] for f in ISLAND.split(", ")])

    return run


def packed_provinces(loose: DataFrame, capacity: int) -> DataFrame:
    """``key``, ``length``, and the province and bin of every piece of (key, length)."""
    count = max(1, -(-loose.count() // PROVINCE_PIECES))
    province = F.pmod(F.xxhash64("key"), F.lit(count))
    dealt = loose.groupBy(province.alias("province")).agg(
        F.sort_array(F.collect_list(F.struct("key", F.col("length").cast("int").alias("length")))).alias("own")
    )
    islands = dealt.select(
        "province",
        F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"),
        F.lit(0).alias("n_bins"),
        F.lit(0.0).alias("spread"),
        F.col("own.length").alias("lengths"),
        F.array().cast("array<int>").alias("bins"),
        F.col("own.key").alias("keys"),
        F.array().cast("array<int>").alias("guest"),
    )
    for epoch in range(EPOCHS):
        if epoch:
            # A copy of the elite moves on; the island keeps its own.
            islands = tables.staged(islands, "islands")
            neighbour = ((F.col("island") + 1) % ISLANDS).alias("island")
            guests = islands.select("province", neighbour, F.col("bins").alias("guest"))
            islands = islands.join(guests, ["province", "island"])
        islands = islands.repartition("province", "island").mapInPandas(_epoch(epoch, capacity), ISLAND)
    merit = F.struct(-F.col("n_bins"), F.col("spread"), -F.col("island"))
    best = F.max_by(F.struct("keys", "lengths", "bins"), merit)
    chosen = islands.groupBy("province").agg(best.alias("best"))
    zipped = F.explode(F.arrays_zip("best.keys", "best.lengths", "best.bins")).alias("x")
    return chosen.select("province", zipped).select(
        F.col("x.keys").alias("key"), F.col("x.lengths").alias("length"), "province", F.col("x.bins").alias("bin")
    )


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    numbered_pieces = pieces(docs, tokenizer, capacity).withColumn("key", F.monotonically_increasing_id())
    cut = tables.staged(numbered_pieces, "pieces")
    loose = cut.where(F.col("length") < capacity).select("key", "length")
    first = tables.staged(packed_provinces(loose, capacity), "packed")
    of_bin = Window.partitionBy("province", "bin")
    first = first.withColumn("fill", F.sum("length").over(of_bin))
    is_loose = F.col("fill") < F.lit(int(capacity * LOOSE_FILL))
    again = packed_provinces(first.where(is_loose).select("key", "length"), capacity)
    # Unlike numbers for unlike bins: below zero a full piece's own, else a province, its
    # bin and the round. Keys fill 64 bits, provinces do not: there are fewer than pieces.
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("key"))
    placed = full.select("key", "length", "sequence_id")
    for part, round_ in ((first.where(~is_loose), 0), (again, 1)):
        sequence = (F.col("province") * PROVINCE_PIECES * 4 + F.col("bin")) * 2 + round_
        placed = placed.unionByName(
            part.select("key", F.col("length").cast("long").alias("length"), sequence.alias("sequence_id"))
        )
    before = Window.partitionBy("sequence_id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(
        "key", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset")
    )
    return cut.join(placed, "key").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark, folder: str) -> DataFrame:
    return packed(tables.read(spark, folder, "documents"), default_tokenizer())
