"""Data checks and table facts: profiles, counts, keys and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions import kinds, rendering
from tablekit.operators import lookup
from tablekit.plans.contract import Contract, ForeignKey
from tablekit.sources import storage
from tablekit.sources.catalog import Catalog


def _stacked(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_row_counts(catalog: Catalog) -> DataFrame:
    """Rows of every table, by name; Parquet files are counted from their footers."""
    return _stacked(
        [
            catalog.table(name)
            .agg(F.count(F.lit(1)).alias("n"))
            .select(F.lit(name).alias("table_name"), rendering.whole_count(F.col("n")).alias("row_count"))
            for name in catalog.names
        ]
    )


def table_profile(df: DataFrame, contract: Contract) -> DataFrame:
    """One row per column: type, kind, declared flags and counts seen in the data.

    A single aggregation counts everything; the result is turned on its side after.
    """
    fields = df.schema.fields
    counts = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(F.col(f"`{f.name}`")).alias(f"v{i}") for i, f in enumerate(fields)],
    )
    entries = [
        F.struct(
            F.lit(i + 1).cast("bigint").alias("ordinal"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.lit(kinds.kind_of(f.dataType)).alias("kind"),
            F.lit(f.name not in contract.must_have_value).alias("is_nullable"),
            F.lit(f.name in contract.primary_key).alias("is_primary_key"),
            F.lit(f.name in contract.auto_increment).alias("is_auto_increment"),
            F.col("n").alias("row_count"),
            (F.col("n") - F.col(f"v{i}")).alias("null_count"),
        )
        for i, f in enumerate(fields)
    ]
    profile = counts.select(F.inline(F.array(*entries)))
    by_name = kinds.kind_from_type_name(F.col("data_type"))
    return profile.select(
        F.lit(contract.table).alias("table_name"), *profile.columns, by_name.alias("kind_of_type_name")
    )


def key_report(df: DataFrame, contract: Contract) -> DataFrame:
    """One row: how far the declared key is a key of the data."""
    if not contract.primary_key:
        raise ValueError(f"Table {contract.table} declares no primary key.")
    keys = list(contract.primary_key)
    missing = reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in keys])
    groups = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    repeated = (F.col("n") > 1) & ~missing

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    return groups.agg(
        total(F.col("n")).alias("row_count"),
        total(F.when(missing, F.col("n"))).alias("null_key_rows"),
        total(F.when(repeated, 1)).alias("duplicate_keys"),
        total(F.when(repeated, F.col("n") - 1)).alias("surplus_rows"),
    ).select(F.lit(contract.table).alias("table_name"), F.lit(",".join(keys)).alias("key"), "*")


def _missing_values(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child values without a parent, each with its row count; null is no reference."""
    values = lookup.key_counts(child.select(F.col(f"`{column}`").alias("_value")), ["_value"])
    values = storage.checkpointed(values)
    return values.join(lookup.keys_found(values, ["_value"], parent, [parent_column]), "_value", "left_anti")


def orphan_report(child: DataFrame, table: str, key: ForeignKey, parent: DataFrame) -> DataFrame:
    """One row: distinct values and rows of a reference that point nowhere."""
    missing = _missing_values(child, key.column, parent, key.ref_column)
    return missing.agg(
        F.count(F.lit(1)).alias("orphan_values"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("orphan_rows"),
    ).select(
        F.lit(table).alias("table_name"),
        F.lit(key.column).alias("column_name"),
        F.lit(f"{key.ref_table}.{key.ref_column}").alias("reference"),
        "*",
    )


def reference_report(catalog: Catalog, names: list[str] | None = None) -> DataFrame:
    """Orphan report of every declared reference of the named tables."""
    reports = [
        orphan_report(catalog.table(name), name, key, catalog.table(key.ref_table))
        for name in (names or catalog.names)
        for key in catalog.contract(name).foreign_keys
    ]
    if not reports:
        raise ValueError("No foreign keys are declared.")
    return _stacked(reports)


def orphan_rows(child: DataFrame, key: ForeignKey, parent: DataFrame) -> DataFrame:
    """Child rows whose reference points nowhere."""
    missing = _missing_values(child, key.column, parent, key.ref_column)
    facts = missing.withColumnRenamed("_value", key.column)
    return lookup.attach(child, facts, [key.column], "inner").drop("_n")


def child_counts(parent: DataFrame, parent_key: str, child: DataFrame, child_key: str) -> DataFrame:
    """Parent rows with the number of their children, zero kept.

    Children are counted before the join, so a parent with very many is one row.
    """
    counted = child.groupBy(F.col(f"`{child_key}`").alias("_child_key")).agg(
        F.count(F.lit(1)).alias("_children")
    )
    joined = parent.join(counted, parent[parent_key] == counted["_child_key"], "left")
    return joined.select(
        *[parent[c] for c in parent.columns],
        F.coalesce(F.col("_children"), F.lit(0)).cast("bigint").alias("child_count"),
    )


def next_key_values(catalog: Catalog, columns: dict[str, str]) -> DataFrame:
    """Largest key per table, one for a table without rows."""
    return _stacked(
        [
            catalog.table(name).agg(
                F.coalesce(F.max(F.col(f"`{column}`").cast("bigint")), F.lit(1)).alias("max_key")
            ).select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), "max_key")
            for name, column in sorted(columns.items())
        ]
    )
