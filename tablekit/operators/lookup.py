"""Facts per key attached to rows, whatever share of the rows one key holds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import kinds
from tablekit.sources import storage

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 * 1024 * 1024
HOT_KEYS = 1000

# Writes rows where later steps read them without the work above, and tells if they are few.
Keep = Callable[[DataFrame], tuple[DataFrame, bool]]


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def is_small(df: DataFrame) -> bool:
    """Whether the rows, counted and measured, are few enough to broadcast.

    Counting stops at the limit, so a large table costs no more than a small one.
    """
    return _few(df.limit(MAX_BROADCAST_ROWS + 1).agg(*_size(df)).first().asDict())


def _size(df: DataFrame) -> list[Column]:
    width = reduce(lambda a, b: a + b, [_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
    return [F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")]


def _few(size: dict) -> bool:
    return size["n"] <= MAX_BROADCAST_ROWS and (size["bytes"] or 0) <= MAX_BROADCAST_BYTES


def checkpointed(df: DataFrame) -> tuple[DataFrame, bool]:
    df = storage.checkpointed(df)
    return df, is_small(df)


def staged_in(stage: storage.Stage, purpose: str) -> Keep:
    """Keeps rows as tables of a stage, counted and measured while they are written."""

    def keep(df: DataFrame) -> tuple[DataFrame, bool]:
        seen = Observation()
        out = stage.table(df.observe(seen, *_size(df)), purpose)
        return out, _few(seen.get)

    return keep


def _width(value: Column, data_type: T.DataType) -> Column:
    """Bytes of a value, about; only nested values are written out to be measured."""
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(8))
    if isinstance(data_type, kinds.NESTED_TYPES):
        return F.coalesce(F.octet_length(F.to_json(F.struct(value))), F.lit(8))
    return F.lit(8)


def key_counts(rows: DataFrame, keys: list[str], *facts: Column) -> DataFrame:
    """One row per key without nulls: ``_n`` rows and the given aggregates.

    Partial aggregation shrinks every key to one row per task before the shuffle.
    """
    present = _all([F.col(k).isNotNull() for k in keys])
    return rows.where(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *facts)


def keys_found(
    keys: DataFrame, names: list[str], table: DataFrame, columns: list[str], few: bool | None = None
) -> DataFrame:
    """Those of ``keys`` that the table holds, once each, under their own names.

    A few keys, checked by size unless ``few`` tells, are broadcast, so that the table is
    scanned and never shuffled. ``keys`` is read more than once and should be a written table.
    """
    wanted = keys.select(*[F.col(n).alias(f"_key_{i}") for i, n in enumerate(names)])
    if is_small(wanted) if few is None else few:
        wanted = F.broadcast(wanted)
    held = table.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)])
    same = _all([held[n] == wanted[f"_key_{i}"] for i, n in enumerate(names)])
    return held.join(wanted, same, "left_semi").distinct()


def held_marked(
    values: DataFrame, names: list[str], table: DataFrame, columns: list[str], few: bool
) -> DataFrame:
    """``values``, one row per key with its count ``_n``, and in ``_held`` whether the table holds the key.

    A few keys are broadcast, as in :func:`keys_found`. More of them meet the table's keys in
    one grouping, so that each key is shuffled once and a key that the table repeats is one row
    per task. Keys of the table outside the range of ``values`` stay out of it. ``values`` has
    no other columns and should be a written table.
    """
    held = table.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)])
    if few or any(held.schema[n].dataType != values.schema[n].dataType for n in names):
        found = keys_found(values, names, table, columns, few).withColumn("_held", F.lit(True))
        return values.join(found, names, "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    ranged = [n for n in names if isinstance(values.schema[n].dataType, kinds.INTEGRAL_TYPES)]
    if ranged:
        ends = values.agg(*[end(n).alias(f"{end.__name__}_{n}") for n in ranged for end in (F.min, F.max)]).first()
        held = held.where(_all([F.col(n).between(ends[f"min_{n}"], ends[f"max_{n}"]) for n in ranged]))
    own = values.select(*names, F.col("_n"), F.lit(False).alias("_held"))
    both = own.unionByName(held.select(*names, F.lit(0).cast("bigint").alias("_n"), F.lit(True).alias("_held")))
    met = both.groupBy(*names).agg(F.sum("_n").alias("_n"), F.max("_held").alias("_held"))
    return met.where("_n > 0")


def attach(
    rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "left", keep: Keep = checkpointed
) -> DataFrame:
    """Rows joined to ``facts``, which has one row per key and its count ``_n``.

    Few facts are broadcast, after a check of their size; others are shuffled. ``keep``
    writes the facts, which are read more than once.
    """
    return attach_kept(rows, *keep(facts), keys, how)


def attach_kept(rows: DataFrame, facts: DataFrame, few: bool, keys: list[str], how: str = "left") -> DataFrame:
    """The join of :func:`attach` for facts in a written table."""
    if few:
        return _joined(rows, _prefixed(facts), keys, how, small=True)
    return attach_shuffled(rows, facts, keys, how)


def attach_shuffled(
    rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "left", hot_keys: int = HOT_KEYS
) -> DataFrame:
    """The join of :func:`attach` for facts of any size.

    The facts of the most frequent keys, at most ``hot_keys`` rows, are broadcast.
    Rows with those keys, or without a key, never enter the shuffle. A key outside
    that set holds at most one ``hot_keys``-th of the rows. Which of equally
    frequent keys is in the set changes the path of its rows, never their facts.
    """
    hottest = facts.orderBy(F.desc("_n"), *keys).limit(hot_keys)
    marked = _joined(rows, _prefixed(hottest), keys, "left", small=True)
    matched = F.col("_n").isNotNull()
    keyed = _all([F.col(k).isNotNull() for k in keys])
    settled = marked.where(matched if how == "inner" else matched | ~keyed)
    others = marked.where(~matched & keyed).select(*rows.columns)
    return settled.unionByName(_joined(others, _prefixed(facts), keys, how, small=False))


def _prefixed(facts: DataFrame) -> DataFrame:
    return facts.select(*[F.col(c).alias(f"_fact_{c}") for c in facts.columns])


def _joined(
    rows: DataFrame, facts: DataFrame, keys: list[str], how: str, small: bool
) -> DataFrame:
    same = _all([rows[k] == facts[f"_fact_{k}"] for k in keys])
    joined = rows.join(F.broadcast(facts) if small else facts, same, how)
    added = [c.removeprefix("_fact_") for c in facts.columns]
    return joined.select(
        *[rows[c] for c in rows.columns],
        *[facts[f"_fact_{c}"].alias(c) for c in added if c not in keys],
    )
