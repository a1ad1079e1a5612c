"""Texts whose polynomial modulo 2^64 is equal for every base and numbering of letters."""

from __future__ import annotations

import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from pyspark import cloudpickle

from tablekit.llm import leaks, near, packing, substring, suffixes, tables, texts


def twins(size):
    """A Thue-Morse string and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return tuple("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("size", [1024, 2048, 8192])
@pytest.mark.parametrize("which", [0, 1])
def test_fingerprints_differ(size, which):
    block = texts.Block(0, np.frombuffer("".join(twins(size)).encode(), np.uint8), np.array([0, size, 2 * size]))
    quick = texts.ranges(block.quick_sums(), block.offsets[:-1], block.offsets[1:])
    assert quick[0] == quick[1]
    sound = texts.ranges(block.sums(which), block.offsets[:-1], block.offsets[1:])
    assert sound[0] != sound[1]


def test_equal_ranges_have_equal_fingerprints():
    rng = np.random.default_rng(4)
    part = rng.integers(0, 256, 1000, dtype=np.uint8)
    data = np.concatenate([rng.integers(0, 256, 777, dtype=np.uint8), part, rng.integers(0, 256, 99, dtype=np.uint8), part])
    block = texts.Block(0, data, np.array([0, len(data)]))
    for which in (0, 1):
        a, b = (texts.ranges(block.sums(which), np.arange(990) + at, np.arange(990) + at + 10) for at in (777, 1876))
        assert (a == b).all() and len(set(a.tolist())) > 980


def passages(word):
    return " ".join(f"{word}{i}" for i in range(60))


@pytest.mark.parametrize("size", [1024, 2048])
def test_unlike_documents_stay(spark, size):
    a, b = twins(size)
    rows = [(1, passages(a)), (2, passages(b)), (3, passages(a))]
    removed = {r.doc_id: r.n_removed for r in substring.without_repeats(docs_of(spark, rows)).collect()}
    assert removed == {1: 0, 2: 0, 3: 60}
    linked = {r.doc_id: r.component_id for r in near.near_duplicates(docs_of(spark, rows)).collect()}
    assert linked == {1: 1, 2: 2, 3: 1}
    bytes_removed = {r.doc_id: r.n_removed for r in suffixes.without_repeats(docs_of(spark, rows)).collect()}
    assert bytes_removed == {d: x[1] for d, x in brute.without_byte_repeats(rows, 100).items()}


@pytest.mark.parametrize("size", [1024, 2048])
def test_only_the_item_itself_is_hit(spark, size):
    a, b = twins(size)
    items = spark.createDataFrame([(1, passages(a))], "item_id long, text string")
    rows = leaks.reported(docs_of(spark, [(1, passages(b)), (2, passages(a))]), items).collect()
    assert {r.doc_id: r.n_hit for r in rows} == {1: 0, 2: 60}


def test_tokens_are_those_of_the_text(spark):
    a, b = twins(2048)
    path = packing.default_tokenizer()
    plain = tokenizers.Tokenizer.from_file(path)
    rows = {r.doc_id: r for r in packing.packed(docs_of(spark, [(1, a), (2, b), (3, f"x {b} y")]), path).collect()}
    for doc, text in ((1, a), (2, b), (3, f"x {b} y")):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 0]
        assert rows[doc].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_caches_do_not_travel():
    """Functions go to the workers by value, and tables that a driver has filled stay behind."""
    block = texts.Block(0, np.frombuffer(b"some words", np.uint8), np.array([0, 10]))
    texts.ranges(block.sums(), block.offsets[:-1], block.offsets[1:])
    texts.ranges(block.quick_sums(), block.offsets[:-1], block.offsets[1:])
    assert len(cloudpickle.dumps(leaks.word_prints)) < 100_000
    assert cloudpickle.loads(cloudpickle.dumps(leaks.word_prints))(block)[0].tolist() == leaks.word_prints(block)[0].tolist()


def test_tables_of_powers_are_as_long_as_a_block():
    size = 1 << 19
    texts._POWERS.clear()
    block = next(texts.blocks(pa.array([b"x" * size], pa.binary())))
    texts.ranges(block.sums(), np.array([0, size]), np.array([size, size]))
    texts.ranges(block.quick_sums(), np.array([0, size]), np.array([size, size]))
    assert {len(table) for table in texts._POWERS.values()} == {size + 1}


def test_batches_of_long_texts_are_small(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    docs = spark.range(0, 200, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 20000) AS text")
    got = tables.keyed(docs).mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 200
    assert max(r.bytes for r in got) < 5_000_000


@pytest.mark.parametrize("which", [0, 1])
def test_sums_against_whole_numbers(which):
    values = np.array([2**64 - 1, 0, 1, 2**63, 2**31, texts.PRIMES[which][0]] * 9000, np.uint64)
    ends = np.array([1, 2, 40000, len(values)])
    sums = texts.prefix_sums(values, which)
    got = sums.ranges(np.zeros(4, np.int64), ends)
    for end, value in zip(ends.tolist(), got.tolist(), strict=True):
        parts = []
        for prime, base in zip(texts.PRIMES[which], texts._BASES[which], strict=True):
            total = 0
            for v in reversed(values[:end].tolist()):
                total = (total * base + v) % prime
            parts.append(total)
        assert value == parts[0] << 32 | parts[1]


def test_places_and_tags_need_no_strong_sums():
    data = np.frombuffer(("some words of a text, " * 40).encode(), np.uint8)
    block = texts.Block(0, data, np.array([0, 300, len(data)]))
    place, low, high = suffixes.synchronised(block, 100, 40)
    tags = block.tags()
    assert len(place) and (low <= place).all() and (place < high + 100).all()
    assert tags[0] != tags[1] and (tags >= 0).all() and (tags < 2**31).all()
    assert set(block._sums) == {"quick"}
