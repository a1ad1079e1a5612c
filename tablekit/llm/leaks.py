"""Benchmark decontamination by a generalised suffix automaton of the test items.

Items are lower-cased (A-Z) and cut into words; their automaton takes a document's
words one by one and keeps the longest match that ends at each. A match as long as a
window (``window`` words, or all words of a shorter item) makes its words *hit*, and the
state it ends in knows the items that hold the window.

Only stretches of a document whose neighbouring words are neighbours in some item can
hold a match of two words or more, so just these are streamed through the automaton;
array operations find them. Where an item has a single word, each of its occurrences is
a stretch too.

Items are taken in blocks of at most ``BLOCK_WORDS`` words, each an automaton that is
sent to the tasks, so what is broadcast at once has a fixed bound, whatever the number of
items. Documents pass through all of them in one Python worker a task, without a shuffle:
a worker of its own for each block and for what follows would stay beside the others with
all that it has held. A worker holds the automata of all blocks.

Null texts have no words, items without words no window; items with a null id count
as the item ``""``. Documents are judged row by row, so ties and repeats need no rule.
Other columns are not looked at. An empty table of items hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tablekit.llm import tables, texts

WINDOW = 10
BLOCK_WORDS = 200_000
# Workers keep much of what their arrays have taken, so blocks of texts are small.
BLOCK_BYTES = 1 << 19

MEMBER = np.ones(256, bool)
MEMBER[0x00:0x30] = MEMBER[0x3A:0x61] = MEMBER[0x7B:0x80] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

MAX_COVERAGE_PERCENT = 50


def word_prints(block: texts.Block) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the lower-cased words, and each row's first."""
    lower = texts.Block(block.first, LOWER[block.data], block.offsets)
    starts, ends, first = lower.words(MEMBER)
    return texts.ranges(lower.sums(), starts, ends), first


def pair_prints(words: np.ndarray) -> np.ndarray:
    return texts.mix(words[:-1] * np.uint64(3) + texts.mix(words[1:]))


class Automaton:
    """Suffix automaton of several word sequences, with the windows of each."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, set[str]] = {}

    def _state(self, length: int, link: int, arrows: dict[int, int]) -> int:
        self.next.append(arrows)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def mark(self, item: str, words: list[int]) -> None:
        """Notes the item at the states of its windows; call when all are added."""
        state = 0
        size = min(self.window, len(words))
        for i, word in enumerate(words):
            state = self.next[state][word]
            while self.length[self.link[state]] >= size:
                state = self.link[state]
            if i + 1 >= size:
                known = self.items if size == self.window else self.short
                known.setdefault(state, set()).add(item)

    def close(self) -> None:
        """Per state: the state of its last ``window`` words, and short items it ends with."""
        self.at_window = list(range(len(self.link)))
        self.ends_short: list[tuple[tuple[int, str], ...]] = [()] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[up] >= self.window:
                self.at_window[s] = self.at_window[up]
            own = tuple((self.length[s], item) for item in sorted(self.short.get(s, ())))
            self.ends_short[s] = self.ends_short[up] + own

    def scan(self, words: list[int], base: int, hits: list[tuple[int, int]], found: set[str]) -> None:
        """Streams words; adds hit ranges and the items whose windows occur."""
        state = length = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            state = self.next[state].get(word, 0)
            length = length + 1 if state else 0
            end = base + i + 1
            if length >= self.window:
                items = self.items.get(self.at_window[state])
                if items:
                    hits.append((end - self.window, end))
                    found |= items
            for size, item in self.ends_short[state]:
                if size <= length:
                    hits.append((end - size, end))
                    found.add(item)


class Matcher:
    """The automaton of a block of items, and what finds stretches worth streaming."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window, self.automaton = window, Automaton(window)
        sequences = [(item, _words_of(text)) for item, text in items]
        sequences = [(item, words) for item, words in sequences if len(words)]
        self.vocabulary = np.unique(np.concatenate([w for _, w in sequences] or [np.zeros(0, np.uint64)]))
        numbered = [(item, np.searchsorted(self.vocabulary, w).tolist()) for item, w in sequences]
        for _, words in numbered:
            self.automaton.add(words)
        for item, words in numbered:
            self.automaton.mark(item, words)
        self.automaton.close()
        pairs = [pair_prints(w) for _, w in sequences if len(w) > 1]
        self.pairs = np.unique(np.concatenate(pairs or [np.zeros(0, np.uint64)]))
        self.singles = np.unique(
            np.array([w[0] for _, w in sequences if len(w) == 1] or [], np.uint64)
        )
        sizes = [min(window, len(w)) for _, w in sequences if len(w) > 1]
        self.least = min(sizes, default=window)

    @staticmethod
    def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Membership in a sorted array, most misses settled by a bit table."""
        if not len(known) or not len(values):
            return np.zeros(len(values), bool)
        bits = np.zeros(1 << 20, bool)
        shift = np.uint64(44)
        bits[known >> shift] = True
        out = bits[values >> shift]
        at = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(known, values[at]), len(known) - 1)
        out[at] = known[place] == values[at]
        return out

    def stretches(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
        """Row, first and end word of every stretch that can hold a window."""
        out = []
        if len(words) > 1 and len(self.pairs):
            tied = self._among(pair_prints(words), self.pairs)
            tied[first[(first > 0) & (first < len(words))] - 1] = False
            edge = np.diff(np.r_[False, tied, False].astype(np.int8))
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
            long = end - start >= self.least
            out += list(zip(start[long].tolist(), end[long].tolist(), strict=True))
        lone = np.flatnonzero(self._among(words, self.singles))
        out += [(i, i + 1) for i in lone.tolist()]
        rows = np.searchsorted(first, [s for s, _ in out], "right") - 1
        return [(int(r), s, e) for r, (s, e) in zip(rows, out, strict=True)]

    def match(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]], set[str]]]:
        """Row, hit ranges and items of every row with a window."""
        by_row: dict[int, tuple[list, set]] = {}
        for row, start, end in self.stretches(words, first):
            hits, found = by_row.setdefault(row, ([], set()))
            part = words[start:end]
            place = np.minimum(np.searchsorted(self.vocabulary, part), len(self.vocabulary) - 1)
            numbers = np.where(self.vocabulary[place] == part, place, -1).tolist()
            self.automaton.scan(numbers, start - int(first[row]), hits, found)
        for row, (hits, found) in by_row.items():
            if hits:
                yield row, hits, found


def _words_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_prints(texts.Block(0, data, np.array([0, len(data)])))[0]


def item_blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """Items, streamed to the driver in blocks of bounded size."""
    rows = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        block.append((item, text))
        size += text.count(" ") + text.count("\n") + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _sent(spark: SparkSession, items: DataFrame, window: int, block_words: int) -> list:
    """The automata of all blocks of items, a broadcast each."""
    tables.lean(spark)
    return [
        spark.sparkContext.broadcast(cloudpickle.dumps(Matcher(block, window)))
        for block in item_blocks(items, block_words)
    ]


def _in_block(known: list[Matcher], block: texts.Block) -> Iterator[tuple[int, list[int], set[str]]]:
    """Per row: how many words it has, the first and end words of all windows in turn, and
    the ids of items with a window in it."""
    words, first = word_prints(block)
    hits: list[list[int]] = [[] for _ in range(block.rows)]
    items: list[set[str]] = [set() for _ in range(block.rows)]
    for matcher in known:
        for row, found, names in matcher.match(words, first):
            hits[row] += [x for pair in found for x in pair]
            items[row] |= names
    yield from zip(np.diff(first).tolist(), hits, items, strict=True)


def _matches(known: list[Matcher], column: pa.Array) -> Iterator[tuple[int, list[int], set[str]]]:
    for block in texts.blocks(column, BLOCK_BYTES):
        yield from _in_block(known, block)


def hit_mask(n_words: int, hits: list[int]) -> np.ndarray:
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, hits[0::2], 1)
    np.add.at(edges, hits[1::2], -1)
    return np.cumsum(edges)[:-1] > 0


def without_hits(text: bytes, hits: list[int]) -> bytes:
    """The text without its hit words and what stands between two of them."""
    data = LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, _ = texts.Block(0, data, np.array([0, len(data)])).words(MEMBER)
    edge = np.diff(np.r_[False, hit_mask(len(starts), hits), False].astype(np.int8))
    at, parts = 0, []
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        parts.append(text[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*parts, text[at:]])


def _count(matchers: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [cloudpickle.loads(m.value) for m in matchers]
        for batch in batches:
            total, hit, count, digest = [], [], [], []
            for n, hits, items in _matches(known, batch.column(1)):
                total.append(n)
                hit.append(int(hit_mask(n, hits).sum()) if hits else 0)
                count.append(len(items))
                digest.append(hashlib.sha256(",".join(sorted(items)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(total, pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array(count, pa.int64()),
                    pa.array(digest, pa.string()),
                ],
                ["doc", "n_words", "n_hit", "n_items", "items_sha256"],
            )

    return run


REPORT = "doc long, n_words long, n_hit long, n_items long, items_sha256 string"


def reported(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    matchers = _sent(docs.sparkSession, items, window, block_words)
    contaminated = (F.col("n_hit") > 0).alias("contaminated")
    return tables.keyed(docs).mapInArrow(_count(matchers), REPORT).select(
        tables.doc_id(), "n_words", "n_hit", "n_items", "items_sha256", contaminated
    )


def _clean(matchers: list, max_percent: int):
    """Removes hits until none is left, as what stood around one may make another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [cloudpickle.loads(m.value) for m in matchers]
        for batch in batches:
            clean, keep = [], []
            for text, (words, own, _) in zip(batch.column(1), _matches(known, batch.column(1)), strict=True):
                if not own:
                    clean.append(None)
                    keep.append(True)
                    continue
                text = text.as_py().encode()
                covered = int(hit_mask(words, own).sum())
                keep.append(covered * 100 <= words * max_percent)
                while own and keep[-1]:
                    text = without_hits(text, own)
                    block = texts.Block(0, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                    ((_, own, _),) = _in_block(known, block)
                clean.append(text.decode())
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string())], ["doc", "clean"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


def decontaminated(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_percent: int = MAX_COVERAGE_PERCENT,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of ``docs`` with hit words cut out of their texts; rows of which more than
    ``max_percent`` of all words are hit go. Other columns stay as they are."""
    row = tables.whole_row(docs).alias("doc")
    rows = docs.select(row, F.coalesce(docs["text"], F.lit("")).alias("text"))
    matchers = _sent(docs.sparkSession, items, window, block_words)
    schema = StructType([rows.schema["doc"], StructField("clean", StringType())])
    out = rows.mapInArrow(_clean(matchers, max_percent), schema)
    text = F.coalesce("clean", F.col("doc")["text"]).alias("text")
    return out.select(*[text if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def query(spark, folder: str) -> DataFrame:
    docs, items = (tables.read(spark, folder, name) for name in ("documents", "benchmark"))
    return reported(docs, items)
