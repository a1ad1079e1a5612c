"""Packing: exact ids, whole documents, few sequences."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablekit.llm import packing, texts

PATH = packing.default_tokenizer()
TOKENIZER = Tokenizer.from_file(PATH)
TEXT = st.text(
    alphabet=st.sampled_from(list("ab'stré \n\t!,19  　\u0085\x1c\x1f日<|endoftext|>")), max_size=60
)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_ids_of_chunks_are_those_of_the_text(rows):
    tokens = packing.Tokens(PATH)
    for _ in range(2):  # the second time all chunks are known
        for block in texts.blocks(pa.array(rows)):
            ids, first = tokens.of(block)
            for i in range(block.rows):
                assert ids[first[i] : first[i + 1]].tolist() == ids_of(rows[block.first + i])


def test_pieces_and_sequences(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["the", "abc", "über", "x9"]) for _ in range(rng.randrange(400)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "word " * 9000), (None, "no id"), (5, "same id"), (5, "same id")]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, key int, bin int")
    rows = packing.packed(df, PATH, capacity=512).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for d, text in docs:
        if d == 5:
            continue
        ids = np.array([*ids_of(text), 0], "<u4")
        own = sorted(pieces[d], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 512)))
        assert sum(r.length for r in own) == len(ids) and all(r.length == 512 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert len(pieces[5]) == 3
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(sequences) <= -(-sum(r.length for r in rows) // 512) + 1


def test_evolution_keeps_every_piece_and_the_capacity():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 900, 300)
    bins = packing.evolve(lengths, [], 3, 1000)
    assert np.bincount(bins, weights=lengths).max() <= 1000 and len(bins) == 300
    start = packing.founders(lengths, 1000, np.random.default_rng(2), 3)
    assert packing.fitness(lengths, bins, 1000) >= max(packing.fitness(lengths, f, 1000) for f in start[:1])
    child = packing.crossover(lengths, start[0], start[1], 1000, rng)
    assert np.bincount(child, weights=lengths).max() <= 1000 and (child >= 0).all()
    assert (packing.evolve(lengths, [], 3, 1000) == bins).all()


def test_evolution_beats_best_fit():
    """On lengths of a quarter to a half sequence, where best fit leaves room."""
    lengths = np.random.default_rng(5).integers(500, 1001, 1500)
    plain = packing.founders(lengths, 2048, np.random.default_rng(0), 1)[0]
    first = packing.evolve(lengths, [], 1, 2048)
    assert first.max() < plain.max()
    guest = packing.evolve(lengths, [], 2, 2048)
    both = packing.evolve(lengths, [first, guest], 3, 2048)
    assert packing.fitness(lengths, both, 2048) >= max(packing.fitness(lengths, p, 2048) for p in (first, guest))


def test_evolution_goes_on_while_it_gains():
    """On lengths of which best fit makes 604 sequences, and a few crossovers no fewer."""
    lengths = np.random.default_rng(5).integers(500, 1001, 1500)
    assert packing.evolve(lengths, [], 1, 2048).max() + 1 <= 602


def test_chunks_are_tokenised_in_runs(monkeypatch):
    """Chunks not seen before cost few calls, each chunk's ids are its own, also after a mark of the vocabulary."""
    tokens, calls = packing.Tokens(PATH), []
    plain = tokens._encoded
    monkeypatch.setattr(tokens, "_encoded", lambda chunks: calls.extend(chunks) or plain(chunks))
    rows = ["".join(f" w{i}é<|endoftext|>{i}x\n\ty" for i in range(k, k + 500)) + " end " for k in (0, 300, 5000)]
    for block in texts.blocks(pa.array(rows)):
        ids, first = tokens.of(block)
        for i in range(block.rows):
            assert ids[first[i] : first[i + 1]].tolist() == ids_of(rows[block.first + i])
    assert len(calls) <= 10


def test_sequences_of_late_scan_partitions(spark, monkeypatch):
    """Keys of far partitions fill 64 bits; sequence numbers don't pass them."""
    late = F.monotonically_increasing_id
    monkeypatch.setattr(packing.F, "monotonically_increasing_id", lambda: late() + (30_000 << 33))
    docs = [(i, "word " * (40 * i)) for i in range(30)]
    rows = packing.packed(spark.createDataFrame(docs, "doc_id long, text string"), PATH, capacity=128).collect()
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 128 and sum(n == 128 for n in used.values()) >= sum(r.length == 128 for r in rows) > 20


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert packing.packed(df, PATH).collect() == []
