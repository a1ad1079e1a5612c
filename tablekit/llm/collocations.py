"""Collocations by top-order marginalisation.

At every word the longest window is read off with lead columns: the word and those that
follow it in its piece, padded where the piece ends. Only these windows are counted.
Every shorter phrase is a prefix of the windows that start where it starts, so ROLLUP
over the window's columns sums the counts of all orders, down to single words and to all
words of a language, without another pass over the texts for each order.

Only phrases that reach the least count are wanted, and each phrase in such a phrase
reaches it too. So windows are padded from where a shorter phrase in them stays below.
Which do is told by passes that count pairs, and then those triples whose pairs are left,
by 64-bit hashes. Phrases that share a hash only leave more in the windows, so no count
changes. Tasks get the frequent hashes modulo
``FILTER_SLOTS``, as one bit for each slot whatever the corpus holds; slots that are
shared keep more, never less. Words of a block of texts are found by array operations,
and a block's phrases and windows are counted before they leave it, so one that is very
frequent is a row for each block and, after partial aggregation, for each task.

A phrase is attached to what it is cut into by joins with unique keys on the other side.

Null texts have no words; a null language counts as ``und``. Rows that repeat, or share
an id, all count. Ties of score and count go by the phrase's bytes, so the result has one
order. A very long text is a block of its own, held whole in a task. Other
columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablekit.llm import tables, texts

LONGEST = 4
MIN_COUNT = 30
COVERED_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
PAD = ""
NO_LANGUAGE = "und"
FILTER_SLOTS = 1 << 26
BLOCK_BYTES = 1 << 20

# Where pieces and words end.
BREAK = texts.table_of(b".,;:!?\n\x0b\x0c\r")
MEMBER = ~(BREAK | texts.table_of(b" \t"))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[texts.Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks in lower case with starts and ends of their words, the row of each word, and
    for each word but the last whether the next one follows it in the same piece."""
    for batch in batches:
        for block in texts.blocks(batch["text"], BLOCK_BYTES):
            lower = texts.Block(block.first, LOWER[block.data], block.offsets)
            starts, ends, first = lower.words(MEMBER)
            row = texts.rows_of(first)
            breaks = np.cumsum(BREAK[lower.data])[starts] if len(starts) else starts
            yield lower, starts, ends, row, (row[1:] == row[:-1]) & (breaks[1:] == breaks[:-1])


def _language_numbers(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) for x in batch["lang"].to_pylist()], np.uint64)


def _hashed(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple]:
    """The blocks of :func:`_worded` with their batch, and for each order from 2 up to
    ``longest`` a 64-bit hash of the phrase at each word, and whether its piece holds it."""
    for batch in batches:
        languages = _language_numbers(batch)
        for block, starts, ends, row, follows in _worded(iter([batch])):
            words = texts.ranges(block.quick_sums(), starts, ends)
            phrase, held = words ^ languages[block.first + row], np.ones(len(words), bool)
            grams = {}
            for order in range(2, longest + 1):
                held = held[:-1] & follows[order - 2 :]
                phrase = texts.mix(phrase[:-1] * np.uint64(3) + texts.mix(words[order - 1 :]))
                grams[order] = phrase, held
            yield batch, block, starts, ends, row, grams


def _usable(grams: dict, order: int, known: dict[int, np.ndarray], n_slots: int) -> np.ndarray:
    """Where a piece holds a phrase of an order whose hash is flagged, if flags are known."""
    phrase, held = grams[order]
    return held & _flagged(known[order], phrase, n_slots) if order in known else held


def frequent_slots(rows: DataFrame, min_count: int, order: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """A bit for each slot: whether a phrase of an order that falls in it may reach the least
    count. Phrases in which a shorter one is known to stay below are not counted. Words of
    64 bits come to the driver, at most one for 64 slots."""
    n_slots = FILTER_SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, grams in _hashed(batches, order):
            phrase, held = grams[order]
            for shorter in known:
                usable = _usable(grams, shorter, known, n_slots)
                for first in range(order - shorter + 1):
                    held = held & usable[first : first + len(held)]
            found, n = np.unique(phrase[held], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(texts.signed(found)), pa.array(n.astype(np.int64))], ["phrase", "n"])

    counted = rows.mapInArrow(count, "phrase long, n long").groupBy("phrase").agg(F.sum("n").alias("n"))
    slots = counted.where(F.col("n") >= min_count).select(F.pmod("phrase", F.lit(n_slots)).alias("slot"))
    bit = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    words = slots.groupBy((F.col("slot") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    found = words.toArrow()
    bits = np.zeros(-(-n_slots // 64), np.uint64)
    bits[texts.numbers(found["word"].combine_chunks())] = texts.numbers(found["bits"].combine_chunks()).view(np.uint64)
    return bits


def _flagged(bits: np.ndarray, phrases: np.ndarray, n_slots: int) -> np.ndarray:
    slots = np.mod(texts.signed(phrases), n_slots)
    return (bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1


def _strings(block: texts.Block, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """The texts of ranges of a block."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = block.data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], sizes)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def windows(rows: DataFrame, known: dict[int, np.ndarray], longest: int) -> DataFrame:
    """``n`` of each padded longest window ``w1, w2, ...`` of a block, cut where a phrase in
    it is known to stay below the least count."""
    names, n_slots = [f"w{k}" for k in range(1, longest + 1)], FILTER_SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block, starts, ends, row, grams in _hashed(batches, max(longest - 1, 2)):
            size = len(starts)
            padded = lambda flags: np.append(flags, np.zeros(size + longest - len(flags), flags.dtype))
            usable = {order: padded(_usable(grams, order, known, n_slots)) for order in grams}
            words = _strings(block, starts, ends).dictionary_encode()
            codes = padded(texts.numbers(words.indices))
            lead, ahead = np.ones(size, bool), [codes[:size]]
            for k in range(1, longest):
                # Lead column k: the word k places on, or the pad, code -1. All phrases that
                # end with it and start in the window have to be usable.
                for order, flags in usable.items():
                    if order <= k + 1:
                        lead = lead & flags[k + 1 - order : k + 1 - order + size]
                ahead.append(np.where(lead, codes[k : k + size], -1))
            languages = batch["lang"].take(pa.array(block.first + row)).dictionary_encode()
            table = pa.table([pa.array(texts.numbers(languages.indices)), *map(pa.array, ahead)], ["lang", *names])
            table = table.group_by(table.column_names).aggregate([([], "count_all")])
            texts_of = pa.concat_arrays([words.dictionary, pa.array([PAD], pa.large_string())])
            columns = [languages.dictionary.take(table["lang"].combine_chunks())]
            for name in names:
                code = texts.numbers(table[name].combine_chunks())
                columns.append(texts_of.take(pa.array(np.where(code < 0, len(texts_of) - 1, code))).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, table["count_all"].combine_chunks()], ["lang", *names, "n"])

    schema = ", ".join(["lang string", *(f"{n} string" for n in names), "n long"])
    return rows.mapInArrow(count, schema)


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """``lang``, ``words`` and ``f`` of all phrases of up to ``longest`` words with at least
    ``min_count`` occurrences, and one row without words for each language: its number of
    words."""
    rows = docs.select(
        F.coalesce(docs["lang"], F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(docs["text"], F.lit("")).alias("text")
    )
    names = [f"w{k}" for k in range(1, longest + 1)]
    known: dict[int, np.ndarray] = {}
    for order in range(2, max(longest, 3)):
        known[order] = frequent_slots(rows, min_count, order, known)
    counted = windows(rows, known, longest).groupBy("lang", *names).agg(F.sum("n").alias("n"))
    summed = counted.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("above"))
    # Columns that a row sums over are null; grouping ids below the last leave the language.
    words = F.array_compact(F.array(*[F.col(n) for n in names]))
    rows = summed.where(F.col("above") < 2 ** (longest + 1) - 1).select("lang", words.alias("words"), "f")
    last = F.get("words", F.size("words") - 1)
    return rows.where((F.size("words") == 0) | ((F.col("f") >= min_count) & (last != PAD)))


def _text(words: Column) -> Column:
    return F.array_join(words, " ")


def mined(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    longest: int = LONGEST,
    covered_percent: int = COVERED_PERCENT,
    top: int = TOP,
) -> DataFrame:
    """The first ``top`` phrases of each language by score, count and bytes.

    A phrase scores by its weakest cut; it goes where a longer frequent phrase that holds
    it has ``covered_percent`` of its occurrences.
    """
    found = tables.staged(
        frequent_phrases(docs, min_count, longest).withColumn("phrase", _text(F.col("words"))), "phrases"
    )
    size = F.size("words")
    n = found.where(size == 0).select("lang", F.col("f").alias("n"))
    counts = found.where(size > 0).select("lang", "phrase", "f")
    candidates = found.where(size > 1).withColumnRenamed("f", "a")

    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut",
        _text(F.slice("words", 1, F.col("cut"))).alias("first"),
        _text(F.slice("words", F.col("cut") + 1, F.size("words"))).alias("rest"),
    )
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    wide = "CAST({} AS DECIMAL(20,0))".format
    score = F.expr(f"{wide(SCALE)} * {wide('a')} div ({wide('l')} + {wide('r')})")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    weakest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("cut"))

    inside = F.flatten(
        F.transform(
            F.sequence(F.lit(2), size - 1),
            lambda k: F.transform(
                F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: _text(F.slice("words", i, k))
            ),
        )
    )
    longer = candidates.where(size > 2).select("lang", F.explode(inside).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longest_a"))
    covered = F.col("longest_a").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * covered_percent
    left_over = weakest.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))

    order = W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    ranked = left_over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"),
    )


def query(spark, folder: str) -> DataFrame:
    return mined(tables.read(spark, folder, "documents"))


SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, '{NO_LANGUAGE}') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang
), placed AS (
  SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM worded
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM placed, (SELECT unnest(generate_series(1, {LONGEST})) AS k) WHERE i + k - 1 <= len(w)
), counts AS (
  SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY lang, phrase, k HAVING count(*) >= {MIN_COUNT}
), candidates AS (
  SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1
), cuts AS (
  SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM candidates
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, p.f AS l, q.f AS r,
    CAST({SCALE} * CAST(c.a AS HUGEINT) // (p.f + q.f) AS BIGINT) AS score
  FROM cuts c JOIN counts p ON p.lang = c.lang AND p.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN counts q ON q.lang = c.lang AND q.phrase = array_to_string(c.w[c.cut + 1:], ' ')
), weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, array_to_string(w[i:j], ' ') AS phrase, max(a) AS longest_a
  FROM (SELECT *, unnest(generate_series(i + 1, k)) AS j FROM
    (SELECT *, unnest(generate_series(1, k - 1)) AS i FROM candidates)) WHERE j - i + 1 < k GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest LEFT JOIN inside USING (lang, phrase) JOIN totals USING (lang)
WHERE longest_a IS NULL OR 100 * longest_a < {COVERED_PERCENT} * a
QUALIFY rank <= {TOP}
"""
