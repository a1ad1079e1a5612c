"""Keys and references of tables that declare none, found from their values."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import kinds
from tablekit.sources import storage
from tablekit.sources.catalog import Catalog

SHORT_TEXT = 64
BITS = 63
SHARE = 64
SETS_AT_ONCE = 32


@dataclass(frozen=True)
class _Column:
    number: int
    table: str
    name: str


def _comparable(data_type: T.DataType) -> str | None:
    """Columns that may refer to each other have one such class; others None."""
    if isinstance(data_type, kinds.INTEGRAL_TYPES):
        return "whole"
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, (T.DateType, *kinds.TIMESTAMP_TYPES)):
        return "time"
    return None


def _value(column: Column, kind: str) -> Column:
    """Class and text of a value; long text counts by its SHA-256."""
    text = column.cast("string")
    if kind == "text":
        text = F.when(F.octet_length(text) <= SHORT_TEXT, text).otherwise(F.concat(F.lit("#"), F.sha2(text, 256)))
    return F.concat(F.lit(f"{kind}:"), text)


def column_values(catalog: Catalog) -> tuple[DataFrame, list[_Column]]:
    """Each value of each column that may be a key, once, with its number of rows.

    Values are counted before they are shuffled, so one that is very frequent is a row
    for each task. Nulls are no values.
    """
    columns: list[_Column] = []
    frames = []
    for name in catalog.names:
        df, entries = catalog.table(name), []
        for field in df.schema.fields:
            kind = _comparable(field.dataType)
            if kind is None:
                continue
            columns.append(_Column(len(columns), name, field.name))
            entries.append(F.struct(F.lit(columns[-1].number).alias("column"), _value(F.col(f"`{field.name}`"), kind).alias("value")))
        if entries:
            frames.append(df.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull()))
    if not frames:
        raise ValueError("No column can be compared.")
    return reduce(DataFrame.unionByName, frames).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), columns


def discovered_references(catalog: Catalog) -> DataFrame:
    """Every column whose values are all in a key column of a table.

    A key column holds each of its values once and no null. One grouping gives, for each
    value, the set of columns that hold it; a column is included in those that are in the
    sets of all of its values, found by a bitwise AND of the sets. ``coverage`` is the
    share of the key's values that are referred to; columns without values refer to
    nothing.
    """
    values, columns = column_values(catalog)
    with_nulls = {c.number: c for c in columns}
    stage = storage.Stage()
    values = stage.table(values, "values")
    words = range(-(-len(columns) // BITS))

    def bit(w: int) -> Column:
        inside = F.col("column") - F.lit(w * BITS)
        return F.when((inside >= 0) & (inside < BITS), F.expr(f"shiftleft(1L, CAST(column - {w * BITS} AS INT))")).otherwise(F.lit(0))

    sets = values.groupBy("value").agg(
        F.collect_list("column").alias("columns"), *[F.bit_or(bit(w)).alias(f"set{w}") for w in words]
    )
    each = sets.select(F.explode("columns").alias("column"), *[f"set{w}" for w in words])
    included = each.groupBy("column").agg(*[F.bit_and(f"set{w}").alias(f"set{w}") for w in words])
    facts = values.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_values"), F.sum("n").alias("filled_rows"), F.max("n").alias("most")
    )
    # From here on there is one row per column, or pair of columns, of the schema.
    rows = {name: catalog.table(name).count() for name in {c.table for c in columns}}
    held = {r["column"]: r for r in facts.collect()}
    found = []
    for r in included.collect():
        child = with_nulls[r["column"]]
        for parent in columns:
            word, place = divmod(parent.number, BITS)
            if parent.number == child.number or not (r[f"set{word}"] >> place) & 1:
                continue
            fact = held[parent.number]
            if fact["most"] == 1 and fact["filled_rows"] == rows[parent.table]:
                known = held[child.number]["distinct_values"]
                found.append((child.table, child.name, parent.table, parent.name, known, known / fact["distinct_values"]))
    stage.release()
    schema = "table_name string, column_name string, ref_table string, ref_column string, distinct_values long, coverage double"
    return catalog.table(catalog.names[0]).sparkSession.createDataFrame(sorted(found), schema)


def _unrepeated(df: DataFrame, sets: list[tuple[str, ...]], share: int) -> list[tuple[str, ...]]:
    """Those sets of columns without nulls that hold no values twice, among one in ``share`` of all values.

    Which values are looked at follows from their hash, so all rows of a value are looked at or none.
    """
    kept = []
    for at in range(0, len(sets), SETS_AT_ONCE):
        lot, tests = sets[at : at + SETS_AT_ONCE], []
        for i, names in enumerate(lot):
            chosen = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(share)) == 0
            value = F.struct(*[_shortened(df, c) for c in names])
            tests += [F.count_distinct(F.when(chosen, value)).alias(f"d{i}"), F.count_if(chosen).alias(f"n{i}")]
        seen = df.agg(*tests).first()
        kept += [names for i, names in enumerate(lot) if seen[f"d{i}"] == seen[f"n{i}"]]
    return kept


def _shortened(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    return _value(column, "text") if isinstance(df.schema[name].dataType, T.StringType) else column


def discovered_keys(catalog: Catalog, most_columns: int = 2) -> DataFrame:
    """The smallest sets of columns that tell all rows of a table apart, without nulls.

    Single columns come first; larger sets are tried only for tables that have none. A set
    that repeats one of the values of a share of ``SHARE`` is no key, which most sets show
    with that part of a shuffle; only the others are shuffled whole, so what is found holds
    for all rows. Long text counts by its SHA-256.
    """
    found = []
    for name in catalog.names:
        df = catalog.table(name)
        names = [f.name for f in df.schema.fields if _comparable(f.dataType)]
        if not names:
            continue
        filled = [F.count(F.col(f"`{c}`")).alias(f"f{i}") for i, c in enumerate(names)]
        first = df.agg(F.count(F.lit(1)).alias("n"), *filled).first()
        if not first["n"]:
            continue
        names = [c for i, c in enumerate(names) if first[f"f{i}"] == first["n"]]
        keys: list[tuple[str, ...]] = []
        for size in range(1, most_columns + 1):
            if not keys:
                keys = _unrepeated(df, _unrepeated(df, list(combinations(names, size)), SHARE), 1)
        found += [(name, ",".join(key), len(key)) for key in keys]
    schema = "table_name string, key string, n_columns int"
    return catalog.table(catalog.names[0]).sparkSession.createDataFrame(sorted(found), schema)
