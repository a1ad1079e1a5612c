"""Whole columns of texts as byte arrays: words, fingerprints, rolling fingerprints.

Texts are taken in blocks of about ``BLOCK_BYTES``, cut between rows only, so that a
task holds a few arrays of that size (or of its longest text) and no more.

Fingerprints are polynomials over randomly numbered bytes, modulo two primes of 31 bits
each, mixed at the end. Where a result rests on equality of fingerprints, two independent
ones are used: other primes, other bases and other numbers of the bytes. Polynomials
modulo 2^64 are quicker, but texts of a thousand letters can be made that collide for
every base, so these ``quick`` ones only serve where a collision changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 21
BASE = 0x9E3779B97F4A7C15 | 1
SEED = 20240607

# Two primes just below 2^31 for each of the two numberings, with a base each.
PRIMES = ((2147483647, 2147483629), (2147483587, 2147483579))
_RANDOM = np.random.default_rng(SEED)
_NUMBERS = _RANDOM.integers(1, 2**63, (2, 256), dtype=np.uint64)
_BASES = tuple(tuple(int(_RANDOM.integers(2**29, p - 1)) for p in pair) for pair in PRIMES)
_REDUCED = tuple([numbers % np.uint64(p) for p in pair] for numbers, pair in zip(_NUMBERS, PRIMES, strict=True))
PIECE = 1 << 15


class _Cache(dict):
    """A dictionary that travels empty, as functions that use it travel by value."""

    def __reduce__(self) -> tuple:
        return _Cache, ()


_POWERS = _Cache()


def table_of(members: bytes) -> np.ndarray:
    """Lookup table that is true for the given bytes."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


NOT_SPACE = ~table_of(b" \t\n\x0b\x0c\r")


def _table_size(n: int) -> int:
    """Entries of a table of powers for exponents up to ``n``: those of a block, or of a smaller part of it."""
    return n + 1 if n > BLOCK_BYTES else min(1 << max((n - 1).bit_length(), 16), BLOCK_BYTES) + 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for exponents up to ``n``."""
    have = _POWERS.get("up")
    if have is None or len(have) <= n:
        size = _table_size(n)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def _powers_modulo(prime: int, base: int, n: int) -> np.ndarray:
    """Powers of a base modulo a prime, for exponents up to ``n``."""
    have = _POWERS.get((prime, base))
    if have is None or len(have) <= n:
        size = _table_size(n)
        have = np.ones(1, np.uint64)
        while len(have) < size:
            step = np.uint64(pow(base, len(have), prime))
            have = np.concatenate([have, have[: size - len(have)] * step % np.uint64(prime)])
        # Kept in half the room; a product with 64-bit numbers has 64 bits again.
        have = _POWERS[prime, base] = have.astype(np.uint32)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _folded(x: np.ndarray, prime: int) -> np.ndarray:
    """Numbers below 2^63 as equal ones modulo the prime, below 2^31 + 2^15; twice as quick as a division."""
    rest, bits, low = np.uint64(2**31 - prime), np.uint64(31), np.uint64(2**31 - 1)
    for _ in range(2):
        x = (x >> bits) * rest + (x & low)
    return x


class Sums:
    """Prefix sums of a polynomial modulo two primes, from which any range's value follows.

    A sum of as many terms as memory holds stays below 2^63, so sums are not reduced. Arrays
    are taken in pieces that a processor's cache holds.
    """

    def __init__(self, values: np.ndarray, which: int) -> None:
        """Of 64-bit numbers, or of bytes by their numbers."""
        self.which = which
        self.sums = []
        for k, (prime, base) in enumerate(zip(PRIMES[which], _BASES[which], strict=True)):
            up = _powers_modulo(prime, base, len(values))
            sums = np.zeros(len(values) + 1, np.uint64)
            for a in range(0, len(values), PIECE):
                some = values[a : a + PIECE]
                terms = _REDUCED[which][k][some] if some.dtype == np.uint8 else some % np.uint64(prime)
                sums[a + 1 : a + 1 + len(some)] = _folded(terms * up[a : a + len(some)], prime)
            self.sums.append(np.cumsum(sums, out=sums))

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        for prime, base, sums in zip(PRIMES[self.which], _BASES[self.which], self.sums, strict=True):
            p = np.uint64(prime)
            down = _powers_modulo(prime, pow(base, -1, prime), len(sums) - 1)
            for a in range(0, len(starts), PIECE):
                first = starts[a : a + PIECE]
                part = _folded(_folded(sums[ends[a : a + PIECE]] - sums[first], prime) * down[first], prime)
                np.subtract(part, p, out=part, where=part >= p)
                out[a : a + PIECE] = out[a : a + PIECE] << np.uint64(32) | part
        return out


def prefix_sums(values: np.ndarray, which: int = 0) -> Sums:
    """Sums of ``values[i] * base**i``; ``which`` chooses one of two independent families."""
    return Sums(values, which)


def quick_sums(values: np.ndarray) -> np.ndarray:
    """The same modulo 2^64, for use where a collision changes no result."""
    up, _ = powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums


def windows(sums: np.ndarray, width: int) -> np.ndarray:
    """Quick fingerprints of every ``width`` neighbours."""
    n = len(sums) - width
    _, down = powers(len(sums) - 1)
    return mix((sums[width:] - sums[:n]) * down[:n])


def ranges(sums: Sums | np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the ranges, equal for equal values wherever they stand."""
    lengths = (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    if isinstance(sums, Sums):
        return mix(sums.ranges(starts, ends) + lengths)
    _, down = powers(len(sums) - 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + lengths)


class Block:
    """Neighbouring rows of a batch: ``data`` holds their texts from ``offsets`` on."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray) -> None:
        self.first, self.data, self.offsets = first, data, offsets
        self._sums: dict[int | str, Sums | np.ndarray] = {}

    def sums(self, which: int = 0) -> Sums:
        """Prefix sums of the bytes; ``which`` chooses one of two numberings."""
        if which not in self._sums:
            self._sums[which] = prefix_sums(self.data, which)
        return self._sums[which]

    def quick_sums(self) -> np.ndarray:
        if "quick" not in self._sums:
            self._sums["quick"] = quick_sums(_NUMBERS[0][self.data])
        return self._sums["quick"]

    def tags(self) -> np.ndarray:
        """31 bits of each text, to tell rows apart that share an id."""
        prints = [hashlib.blake2b(self.text(row), digest_size=4).digest() for row in range(self.rows)]
        return np.frombuffer(b"".join(prints), "<u4").astype(np.int64) >> 1

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()

    def words(self, member: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all maximal runs of member bytes, and per row its first run."""
        inside = member[self.data]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        first = np.flatnonzero(starts)
        return first, np.flatnonzero(ends) + 1, np.searchsorted(first, self.offsets)


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column without nulls, block by block."""
    if len(column) == 0:
        return
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64 if large else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield Block(row, values[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row of every item, where ``first`` has each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists of numbers; null lists are empty."""
    lengths = pc.fill_null(pc.list_value_length(column), 0)
    return np.concatenate([[0], np.cumsum(numbers(lengths))]), numbers(column.flatten())
