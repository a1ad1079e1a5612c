"""Fakes for keys that never collide: a keyed permutation of whole numbers.

A Feistel network over the two halves of a number permutes all numbers of its width,
whatever its round function is; here that is an MD5 of the seed, the round and a half.
Where fakes have to lie below a bound, a number outside is permuted again until it falls
inside ("cycle walking"), which permutes the numbers below the bound.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import fakes, parsing

ROUNDS = 4
# A walk leaves the bound with less than half its steps, so this is never reached.
MOST_STEPS = 128
TOO_LONG = "Key walked too far."


def _permuted(value: Column, half: int, domain: tuple[str, ...]) -> Column:
    """The permutation of numbers of two halves of ``half`` bits, given without a sign."""
    mask = F.lit((1 << half) - 1)
    zero = F.struct(
        F.shiftrightunsigned(value, half).bitwiseAND(mask).alias("left"), value.bitwiseAND(mask).alias("right")
    )

    def turn(state: Column, number: Column) -> Column:
        text = F.concat_ws(fakes.SEPARATOR, number.cast("string"), state["right"].cast("string"))
        mixed = fakes.hex_number(fakes.digest(domain, text), 1).bitwiseAND(mask)
        return F.struct(state["right"].alias("left"), state["left"].bitwiseXOR(mixed).alias("right"))

    numbers = F.array(*[F.lit(r) for r in range(ROUNDS)])
    return F.aggregate(
        numbers, zero, turn, lambda s: F.shiftleft(s["left"], half).bitwiseOR(s["right"])
    )


def permuted_key(value: Column, data_type: T.DataType, domain: tuple[str, ...], below: int | None = None) -> Column:
    """The fake of a whole number, one for each number of its type; null stays null.

    With ``below``, keys from 0 up to that bound get fakes of that range; a key outside
    of it is an error.
    """
    if below is None:
        bits = parsing.INTEGER_BITS[type(data_type)]
        fake = _permuted(value.cast("long"), bits // 2, domain)
        # The unsigned number of the width, as the type's own number.
        sign, span = 1 << (bits - 1), 1 << bits
        signed = fake if bits == 64 else F.when(fake >= sign, fake - F.lit(span)).otherwise(fake)
        return F.when(value.isNotNull(), signed).cast(data_type)
    half = max(((below - 1).bit_length() + 1) // 2, 1)
    bound = F.lit(below)
    number = value.cast("long")
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST_STEPS)),
        _permuted(number, half, domain),
        lambda state, _: F.when(state < bound, state).otherwise(_permuted(state, half, domain)),
    )
    sound = (number >= 0) & (number < bound)
    checked = F.when(sound & (walked < bound), walked).otherwise(F.raise_error(F.lit(TOO_LONG)).cast("long"))
    return F.when(value.isNotNull(), checked).cast(data_type)


def hashed_key(text: Column, domain: tuple[str, ...]) -> Column:
    """The fake of a key that is text: its SHA-256, of which no two equal ones are known."""
    prefix = "".join(part + fakes.SEPARATOR for part in domain)
    return F.sha2(F.concat(F.lit(prefix), text), 256)
