"""Validated inserts and updates by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import parsing
from tablekit.operators import lookup
from tablekit.plans.contract import Contract
from tablekit.sources import storage

INSERT = "insert"
UPDATE = "update"
FIELD_ERRORS = "field_errors"
ERROR = "error"

# Messages of refused writes.
UNKNOWN_COLUMN = "Unknown column."
KEY_NOT_EDITABLE = "Primary key columns cannot be edited."
NO_VALUES = "No editable values were provided."
NO_KEY = "This table has no primary key. Row update is disabled."
KEY_MISSING = "Missing primary key value."
KEY_NULL = "Primary key value cannot be null."
VALIDATION_FAILED = "Validation failed."
INVALID_IDENTITY = "Invalid row identity."
KEY_EXISTS = "The key is in use already."
NOT_FOUND = "No row was updated. The target row may no longer exist."

_ERROR_ENTRY = "array<struct<field:string,message:string>>"


def _entry(name: Column, message: Column) -> Column:
    return F.struct(name.alias("field"), message.alias("message"))


def validate_rows(
    requests: DataFrame,
    contract: Contract,
    mode: str = INSERT,
    values: str = "values",
    identity: str = "identity",
) -> DataFrame:
    """Typed values and errors of write requests, one request per row.

    ``values``, and for updates ``identity``, are ``map<string,string>`` columns
    from column name to text. Adds ``new_<column>`` and ``has_<column>`` (a usable
    value was given) per column, ``key_<column>`` per key column of an update,
    ``field_errors`` and ``error``. A request is sound where ``error`` is null.
    """
    if mode not in (INSERT, UPDATE):
        raise ValueError(f"Unknown write mode: {mode}")
    if mode == UPDATE and not contract.primary_key:
        raise ValueError(NO_KEY)
    key = contract.primary_key if mode == UPDATE else ()
    fields = [(i, f.name, f.dataType) for i, f in enumerate(contract.schema.fields)]
    editable = [(i, name, kind) for i, name, kind in fields if name not in key]
    key_fields = [(i, name, contract.schema[name].dataType) for i, name in enumerate(key)]
    given = F.col(values)

    # Every step names the columns of the step before many times, so each is a
    # projection of its own and no formula is repeated.
    texts = requests.select(
        "*",
        *[
            parsing.body_of(F.col(identity)[name], kind).alias(f"_key_text_{i}")
            for i, name, kind in key_fields
        ],
        *[parsing.body_of(given[name], kind).alias(f"_text_{i}") for i, name, kind in fields],
        *[F.map_contains_key(given, name).alias(f"_present_{i}") for i, name, _ in fields],
    )
    typed = texts.select(
        "*",
        *[
            parsing.written_value(F.col(f"_key_text_{i}"), kind).alias(f"key_{name}")
            for i, name, kind in key_fields
        ],
        *[
            parsing.written_value(F.col(f"_text_{i}"), kind).alias(f"new_{name}")
            for i, name, kind in editable
        ],
    )

    def value_error(i: int, name: str, kind: T.DataType) -> Column:
        if name in key:
            return F.when(F.col(f"_present_{i}"), KEY_NOT_EDITABLE)
        return parsing.write_error(F.col(f"_text_{i}"), F.col(f"new_{name}"), name, kind)

    def key_error(i: int, name: str, kind: T.DataType) -> Column:
        text, value = F.col(f"_key_text_{i}"), F.col(f"key_{name}")
        return (
            F.when(F.coalesce(F.col(identity)[name], F.lit("")) == "", KEY_MISSING)
            .when(parsing.is_blank(text, kind), KEY_NULL)
            .otherwise(parsing.write_error(text, value, name, kind))
        )

    known = sum((F.col(f"_present_{i}").cast("int") for i, _, _ in fields), F.lit(0))
    judged = typed.select(
        "*",
        *[value_error(*field).alias(f"_error_{field[0]}") for field in fields],
        *[key_error(*field).alias(f"_key_error_{field[0]}") for field in key_fields],
        (F.size(F.map_keys(given)) > known).alias("_has_unknown"),
    )
    errors = [(name, f"_error_{i}") for i, name, _ in fields]
    key_errors = [(name, f"_key_error_{i}") for i, name, _ in key_fields]
    usable = {name: F.col(f"_present_{i}") & F.col(f"_error_{i}").isNull() for i, name, _ in editable}
    decided = judged.select(
        "*",
        *[flag.alias(f"has_{name}") for name, flag in usable.items()],
        (F.col("_has_unknown") | _any_error(errors)).alias("_bad_values"),
        _any_error(key_errors).alias("_bad_key"),
        (~reduce(lambda a, b: a | b, usable.values(), F.lit(False))).alias("_nothing"),
    )

    # Values are judged first; the key of an update only where they are sound.
    bad_values, bad_key, nothing = F.col("_bad_values"), F.col("_bad_key"), F.col("_nothing")
    strangers = F.array_except(F.map_keys(given), F.array(*[F.lit(c) for c in contract.columns]))
    unknown = F.transform(strangers, lambda n: _entry(n, F.lit(UNKNOWN_COLUMN))).cast(_ERROR_ENTRY)
    no_errors = F.create_map().cast("map<string,string>")
    return decided.select(
        *requests.columns,
        *[c for c in decided.columns if c.startswith(("new_", "key_", "has_"))],
        F.when(bad_values, F.map_from_entries(F.concat(_entries(errors), unknown)))
        .when(~nothing & bad_key, F.map_from_entries(_entries(key_errors)))
        .otherwise(no_errors)
        .alias(FIELD_ERRORS),
        F.when(bad_values, VALIDATION_FAILED)
        .when(nothing, NO_VALUES)
        .when(bad_key, INVALID_IDENTITY)
        .alias(ERROR),
    )


def _any_error(errors: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.col(c) for _, c in errors], F.lit(None).cast("string")).isNotNull()


def _entries(errors: list[tuple[str, str]]) -> Column:
    """Entries of the columns that have an error."""
    every = F.array(*[_entry(F.lit(name), F.col(c)) for name, c in errors]).cast(_ERROR_ENTRY)
    return F.filter(every, lambda e: e["message"].isNotNull())


def sound(validated: DataFrame) -> DataFrame:
    """Requests without an error.

    Taken by a generator: a filter would be pushed below the projections, and then
    the whole validation would be worked out again inside it.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in validated.columns])
    kept = F.when(F.col(ERROR).isNull(), F.array(row))
    return validated.select(F.explode(kept).alias("_sound")).select("_sound.*")


def insert_values(validated: DataFrame, contract: Contract) -> DataFrame:
    """Sound inserts as rows of the table; columns without a value are null."""
    return sound(validated).select(*[F.col(f"new_{c}").alias(c) for c in contract.columns])


def judged_inserts(base: DataFrame, rows: DataFrame, contract: Contract, order: str | None = None) -> DataFrame:
    """Rows with ``error`` where the table, or an earlier row, has their key already.

    Earlier is by the column ``order``; without one, rows that repeat a key are all
    refused but for one of equal rows.
    """
    keys = list(contract.primary_key)
    if not keys:
        return rows.withColumn(ERROR, F.lit(None).cast("string"))
    place = F.col(order) if order else F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    rows = storage.checkpointed(rows.withColumns({"_place": place, "_id": F.monotonically_increasing_id()}))
    here = F.struct("_place", "_id")
    groups = storage.checkpointed(lookup.key_counts(rows, keys, F.min(here).alias("_first")))
    held = lookup.keys_found(groups, keys, base, keys).withColumn("_held", F.lit(True))
    contested = groups.join(held, keys, "left").where((F.col("_n") > 1) | F.col("_held").isNotNull())
    refused = F.col("_n").isNotNull() & (F.col("_held").isNotNull() | (here != F.col("_first")))
    marked = lookup.attach(rows, contested, keys).withColumn(ERROR, F.when(refused, KEY_EXISTS))
    return marked.drop("_place", "_id", "_n", "_first", "_held")


def append_rows(base: DataFrame, rows: DataFrame, contract: Contract, order: str | None = None) -> DataFrame:
    """Table with the new rows whose key is new; columns the rows lack are null."""
    accepted = judged_inserts(base, rows, contract, order).where(F.col(ERROR).isNull())
    extra = [ERROR] + ([order] if order and order not in base.columns else [])
    return base.unionByName(accepted.drop(*extra), allowMissingColumns=True)


def latest_patch(validated: DataFrame, contract: Contract, order: str) -> DataFrame:
    """One patch per key: of several writes to a column the last by ``order`` counts,
    and of those with the same order the one with the greatest text.

    The aggregation keeps one row per key and task before its shuffle, so a key
    that is written very often costs no more than any other.
    """
    keys = [f"key_{c}" for c in contract.primary_key]
    editable = [c for c in contract.columns if c not in contract.primary_key]

    def last(name: str) -> Column:
        boxed = F.struct(F.col(f"new_{name}").alias("value"))
        place = F.struct(F.col(order).alias("at"), F.to_json(boxed).alias("tie"))
        return F.max_by(boxed, F.when(F.col(f"has_{name}"), place)).alias(f"set_{name}")

    return sound(validated).groupBy(*keys).agg(*[last(c) for c in editable])


def apply_updates(base: DataFrame, patch: DataFrame, contract: Contract) -> DataFrame:
    """Table with the patched values; a value that was set to null becomes null."""
    patch = storage.checkpointed(patch)
    same = key_match(base, patch, contract)
    # A small patch is broadcast, after a check of its size, and the table not shuffled.
    joined = base.join(F.broadcast(patch) if lookup.is_small(patch) else patch, same, "left")

    def current(name: str) -> Column:
        if name in contract.primary_key:
            return base[name]
        box = patch[f"set_{name}"]
        return F.when(box.isNotNull(), box["value"]).otherwise(base[name]).alias(name)

    return joined.select(*[current(c) for c in base.columns])


def unmatched_updates(base: DataFrame, patch: DataFrame, contract: Contract) -> DataFrame:
    """Patches whose key is in no row of the table, with the error to report."""
    patch = storage.checkpointed(patch)
    names = [f"key_{c}" for c in contract.primary_key]
    found = lookup.keys_found(patch, names, base, list(contract.primary_key))
    missing = patch.join(found, names, "left_anti")
    return missing.select(
        *[F.col(f"key_{c}").alias(c) for c in contract.primary_key], F.lit(NOT_FOUND).alias(ERROR)
    )


def key_match(base: DataFrame, patch: DataFrame, contract: Contract) -> Column:
    return reduce(
        lambda a, b: a & b, [base[c] == patch[f"key_{c}"] for c in contract.primary_key]
    )


def writable(df: DataFrame, contract: Contract, for_update: bool = False) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in contract.writable(for_update)])
