"""Typed values to text: cells of CSV, COPY and SQL, chart labels, time buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import kinds

POSTGRES = "postgres"
MYSQL = "mysql"
SQLITE = "sqlite"
DIALECTS = (POSTGRES, MYSQL, SQLITE)

# Output formats.
ISO_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
ISO_DATE = "yyyy-MM-dd'T'00:00:00.000'Z'"
BUCKET_FORMATS = {
    "hour": "yyyy-MM-dd HH:00:00",
    "day": "yyyy-MM-dd",
    "month": "yyyy-MM-01",
}
COPY_NULL = "\\N"
COPY_END = "\\."
NULL_LABEL = "(null)"
NULL_CELL = "NULL"
ELLIPSIS = "..."


def number_text(value: Column, data_type: T.DataType) -> Column:
    """Decimal text without a trailing ``.0`` and with an exponent only from
    1e21 up or below 1e-6, in the shortest digits that read back equal.

    Casts give those digits but switch to an exponent outside 1e-3 to 1e7, so the
    branches pick the cast that prints the range plainly, cheap ranges first.
    """
    if not isinstance(data_type, kinds.FRACTIONAL_TYPES):
        return value.cast("string")
    if isinstance(data_type, T.FloatType):
        value = value.cast("string").cast("double")  # its digits, not its binary expansion
    size, whole = F.abs(value), value == F.rint(value)
    digits = F.replace(value.cast("string"), F.lit(".0E"), F.lit("E"))
    return (
        F.when(whole & (size < 1e15), value.cast("bigint").cast("string"))
        .when(~whole & (size >= 1e-3) & (size < 1e7), value.cast("string"))
        .when(whole & (size < 1e21), value.cast("decimal(38,0)").cast("string"))
        .when(~whole & (size >= 1e7), _without_zeros(value.cast("decimal(38,10)")))
        .when(~whole & (size >= 1e-6), _without_zeros(value.cast("decimal(38,24)")))
        .when(size < 1, F.lower(digits))
        .otherwise(F.replace(digits, F.lit("E"), F.lit("e+")))
    )


def _without_zeros(value: Column) -> Column:
    return F.rtrim(value.cast("string"), F.lit("0"))


def iso_text(value: Column, data_type: T.DataType, micros: bool = False) -> Column:
    if isinstance(data_type, T.DateType):
        return F.date_format(value, ISO_DATE)
    return F.date_format(value, ISO_MICROS if micros else ISO_TIMESTAMP)


def json_text(value: Column, data_type: T.DataType) -> Column:
    """Compact JSON; arrays of scalars print their numbers like any other cell."""
    if isinstance(data_type, T.ArrayType):
        inner = data_type.elementType
        if isinstance(inner, T.NumericType):
            cells = F.transform(
                value, lambda v: F.coalesce(finite_number_text(v, inner), F.lit("null"))
            )
            return F.when(
                value.isNotNull(), F.concat(F.lit("["), F.array_join(cells, ","), F.lit("]"))
            )
    return F.to_json(value, {"ignoreNullFields": "false", "timestampFormat": ISO_TIMESTAMP})


def finite_number_text(value: Column, data_type: T.DataType) -> Column:
    """Number text, null where the number is NaN or infinite."""
    if not isinstance(data_type, kinds.FRACTIONAL_TYPES):
        return number_text(value, data_type)
    usable = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(usable, number_text(value, data_type))


def text_of(value: Column, data_type: T.DataType, micros: bool = False) -> Column:
    """Text of a value in files: plain numbers, ISO instants, JSON; null stays null."""
    if isinstance(data_type, T.StringType):
        return value
    if isinstance(data_type, T.NumericType):
        return number_text(value, data_type)
    if isinstance(data_type, (T.DateType, *kinds.TIMESTAMP_TYPES)):
        return iso_text(value, data_type, micros)
    if isinstance(data_type, (*kinds.NESTED_TYPES, T.VariantType)):
        return json_text(value, data_type)
    if isinstance(data_type, T.BinaryType):
        return F.base64(value)
    return value.cast("string")


def is_plain(data_type: T.DataType) -> bool:
    """Whether the text of a type holds no quote, backslash, tab or line break."""
    plain = (T.NumericType, T.BooleanType, T.DateType, T.BinaryType, *kinds.TIMESTAMP_TYPES)
    return isinstance(data_type, plain)


def csv_cell(value: Column, data_type: T.DataType) -> Column:
    """Quoted cell, quotes doubled, null as the empty cell."""
    text = F.coalesce(text_of(value, data_type), F.lit(""))
    if not is_plain(data_type):
        text = F.replace(text, F.lit('"'), F.lit('""'))
    return F.concat(F.lit('"'), text, F.lit('"'))


def csv_header(names: list[str]) -> str:
    return ",".join('"' + name.replace('"', '""') + '"' for name in names)


def copy_cell(value: Column, data_type: T.DataType, micros: bool = False) -> Column:
    """COPY text cell. Backslashes go first, so later escapes are not doubled."""
    escaped = text_of(value, data_type, micros)
    if not is_plain(data_type):
        for raw, mark in (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            escaped = F.replace(escaped, F.lit(raw), F.lit(mark))
    return F.coalesce(escaped, F.lit(COPY_NULL))


def copy_cell_text(cell: Column, data_type: T.DataType) -> Column:
    """Text of a COPY cell. Splitting at escaped backslashes leaves pieces in
    which every backslash starts one of the other escapes."""
    if is_plain(data_type):
        return F.when(cell != COPY_NULL, cell)

    def unescape(piece: Column) -> Column:
        for raw, mark in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            piece = F.replace(piece, F.lit(mark), F.lit(raw))
        return piece

    pieces = F.transform(F.split(cell, r"\\\\"), unescape)
    return F.when(~cell.contains("\\"), cell).when(cell != COPY_NULL, F.array_join(pieces, "\\"))


def sql_literal(value: Column, data_type: T.DataType, dialect: str, micros: bool = False) -> Column:
    """Literal in an INSERT statement; null, NaN and infinities become NULL."""
    if isinstance(data_type, T.NullType):
        return F.lit("NULL")
    if isinstance(data_type, T.NumericType):
        literal = finite_number_text(value, data_type)
    elif isinstance(data_type, T.BooleanType):
        yes, no = ("1", "0") if dialect == MYSQL else ("TRUE", "FALSE")
        literal = F.when(value, yes).when(~value, no)
    else:
        text = text_of(value, data_type, micros)
        if not is_plain(data_type):
            text = F.replace(text, F.lit("'"), F.lit("''"))
        literal = F.concat(F.lit("'"), text, F.lit("'"))
    return F.coalesce(literal, F.lit("NULL"))


def quote_identifier(name: str, dialect: str) -> str:
    if dialect == MYSQL:
        return "`" + name.replace("`", "``") + "`"
    return '"' + name.replace('"', '""') + '"'


def display_cell(value: Column, data_type: T.DataType) -> Column:
    """Cell text on screen: like in files, with null shown as ``NULL``."""
    return F.coalesce(text_of(value, data_type), F.lit(NULL_CELL))


def chart_label(text: Column, max_length: int | None = None) -> Column:
    """Axis label: null is named. Long text stays whole, so that no two groups share a
    label, unless ``max_length`` asks for a cut with dots."""
    named = F.when(text.isNull(), NULL_LABEL)
    if max_length is not None:
        short = F.concat(F.substring(text, 1, max_length - len(ELLIPSIS)), F.lit(ELLIPSIS))
        named = named.when(F.length(text) > max_length, short)
    return named.otherwise(text)


def bucket_text(bucket: Column, grain: str) -> Column:
    return F.date_format(bucket, BUCKET_FORMATS[grain])


def whole_count(value: Column) -> Column:
    """Row count as a whole number; negative or missing counts are null."""
    number = value.cast("double")
    usable = (number >= 0) & (number < F.lit(float("inf"))) & ~F.isnan(number)
    return F.when(usable, F.floor(number).cast("bigint"))
