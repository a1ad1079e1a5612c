"""Column kinds: numeric, temporal, boolean, categorical or unknown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "numeric"
TEMPORAL = "temporal"
BOOLEAN = "boolean"
CATEGORICAL = "categorical"
UNKNOWN = "unknown"

# Fragments of a type name that decide its kind, first match wins.
NUMERIC_FRAGMENTS = ("int", "numeric", "decimal", "real", "double", "float", "serial")
TEMPORAL_FRAGMENTS = ("date", "time", "timestamp", "datetime")
BOOLEAN_FRAGMENTS = ("bool",)
BOOLEAN_NAMES = ("tinyint(1)", "bit")

INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL_TYPES = (T.FloatType, T.DoubleType)
TIMESTAMP_TYPES = (T.TimestampType, T.TimestampNTZType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def kind_of(data_type: T.DataType) -> str:
    """Kind of a Spark type; nested types count as categorical."""
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.DateType, *TIMESTAMP_TYPES)):
        return TEMPORAL
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    if isinstance(data_type, T.NullType):
        return UNKNOWN
    return CATEGORICAL


def kind_from_type_name(name: Column) -> Column:
    """Kind of a database type *name*, by substring.

    ``interval`` and ``point`` read as numeric because they contain ``int``,
    and so does ``tinyint(1)``.
    """
    lowered = F.lower(name)

    def has_any(fragments: tuple[str, ...]) -> Column:
        return reduce(lambda a, b: a | b, [lowered.contains(f) for f in fragments])

    return (
        F.when(has_any(NUMERIC_FRAGMENTS), NUMERIC)
        .when(has_any(TEMPORAL_FRAGMENTS), TEMPORAL)
        .when(has_any(BOOLEAN_FRAGMENTS) | lowered.isin(*BOOLEAN_NAMES), BOOLEAN)
        .when(F.length(F.trim(name)) > 0, CATEGORICAL)
        .otherwise(UNKNOWN)
    )


def is_orderable(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.ArrayType):
        return is_orderable(data_type.elementType)
    if isinstance(data_type, T.StructType):
        return all(is_orderable(f.dataType) for f in data_type.fields)
    return not isinstance(data_type, (T.MapType, T.VariantType))
