"""Text to typed values: numbers, booleans and typed column writes."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import kinds

# The number syntax and the boolean words that are understood.
DECIMAL_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER_PATTERN = r"^[+-]?\d+$"
RADIX_PATTERNS = {
    16: r"^0[xX][0-9a-fA-F]{1,16}$",
    8: r"^0[oO][0-7]{1,21}$",
    2: r"^0[bB][01]{1,64}$",
}
RADIX_START = r"^0[xXoObB]"
WHITESPACE = " \t\n\r\f\v" + "".join(map(chr, (0xA0, 0xFEFF, 0x2028, 0x2029)))
FILTER_TRUE = ("true", "1", "yes")
FILTER_FALSE = ("false", "0", "no")
WRITE_TRUE = ("true", "1", "yes", "y")
WRITE_FALSE = ("false", "0", "no", "n")

INTEGER_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def number_from_text(text: str) -> int | float | None:
    """Plan-time twin of :func:`parse_number`; integers stay exact."""
    text = text.strip(WHITESPACE)
    if text == "":
        return 0
    if re.match(INTEGER_PATTERN, text):
        return int(text)
    if re.match(DECIMAL_PATTERN, text):
        value = float(text)
        return value if math.isfinite(value) else None
    for radix, pattern in RADIX_PATTERNS.items():
        if re.match(pattern, text):
            return int(text[2:], radix)
    return None


def boolean_from_text(text: str) -> bool | None:
    """Boolean of a filter value: no trimming, no ``y`` or ``n``."""
    lowered = text.lower()
    if lowered in FILTER_TRUE:
        return True
    if lowered in FILTER_FALSE:
        return False
    return None


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def finite(value: Column) -> Column:
    """The double, or null where it is NaN or infinite."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


# The functions below take trimmed text. They name it several times, so it should
# be a column of the step before and not a formula.


def parse_number(body: Column) -> Column:
    """Strict number: ``1d``, ``NaN`` and ``Infinity`` are null, never an error."""
    plain = body.try_cast("double")
    is_plain = body.rlike(DECIMAL_PATTERN) & (F.abs(plain) < F.lit(float("inf")))
    # The lambda keeps the rare forms out of the code generated for the common one.
    rare = F.get(F.transform(F.array(body), _radix_number), F.lit(0))
    return F.when(is_plain, plain).when(body.rlike(RADIX_START), rare)


def _radix_number(body: Column) -> Column:
    digits = F.substring(body, 3, 64)
    return F.coalesce(
        *[
            F.when(body.rlike(pattern), F.conv(digits, radix, 10).try_cast("double"))
            for radix, pattern in RADIX_PATTERNS.items()
        ]
    )


def parse_boolean(body: Column) -> Column:
    """Lenient boolean of a written value; anything else is null."""
    word = F.lower(body)
    return F.when(word.isin(*WRITE_TRUE), F.lit(True)).when(word.isin(*WRITE_FALSE), F.lit(False))


def metric_number(value: Column, data_type: T.DataType) -> Column:
    """Chart metric as a finite double; numeric text counts, blank text is zero."""
    if isinstance(data_type, T.StringType):
        body = trimmed(value)
        return F.when(body == "", F.lit(0.0)).otherwise(parse_number(body))
    if isinstance(data_type, T.NumericType):
        return finite(value)
    return F.lit(None).cast("double")


def typed_value(body: Column, data_type: T.DataType) -> Column:
    """Value of trimmed text in a column of ``data_type``; null where it does not fit."""
    if isinstance(data_type, kinds.INTEGRAL_TYPES):
        number = parse_number(body)
        return F.when(body.rlike(INTEGER_PATTERN), body.try_cast(data_type)).otherwise(
            F.when(number % 1 == 0, number).try_cast(data_type)
        )
    if isinstance(data_type, T.DecimalType):
        return F.when(body.rlike(DECIMAL_PATTERN), body.try_cast(data_type)).otherwise(
            parse_number(body).try_cast(data_type)
        )
    if isinstance(data_type, kinds.FRACTIONAL_TYPES):
        return parse_number(body).cast(data_type)
    if isinstance(data_type, T.BooleanType):
        return parse_boolean(body)
    if isinstance(data_type, T.StringType):
        return body
    if isinstance(data_type, kinds.NESTED_TYPES):
        return F.from_json(body, data_type, {"mode": "PERMISSIVE"})
    return body.try_cast(data_type)


def body_of(text: Column, data_type: T.DataType) -> Column:
    """What :func:`typed_value` reads: text columns keep their spaces."""
    return text if isinstance(data_type, T.StringType) else trimmed(text)


def is_blank(body: Column, data_type: T.DataType) -> Column:
    inner = trimmed(body) if isinstance(data_type, T.StringType) else body
    return body.isNull() | (inner == "")


def written_value(body: Column, data_type: T.DataType) -> Column:
    """Written value, null where it is blank or does not fit."""
    return F.when(~is_blank(body, data_type), typed_value(body, data_type))


def write_error(body: Column, value: Column, name: str, data_type: T.DataType) -> Column:
    """Error of a written value, null where ``value`` could be read from the text."""
    misfit = F.lit(f"{name} must fit type {data_type.simpleString()}.")
    if isinstance(data_type, kinds.FRACTIONAL_TYPES):
        misfit = F.lit(f"{name} must be numeric.")
    elif isinstance(data_type, T.NumericType):
        number_like = body.rlike(DECIMAL_PATTERN) | body.rlike(RADIX_START)
        misfit = F.when(~number_like, f"{name} must be numeric.").otherwise(misfit)
    elif isinstance(data_type, T.BooleanType):
        misfit = F.lit(f"{name} must be boolean.")
    return F.when(value.isNull() & ~is_blank(body, data_type), misfit)
