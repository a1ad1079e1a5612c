"""Dump text of tables: COPY lines, INSERT batches and the manifest."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import kinds, parsing, rendering
from tablekit.operators.anonymize import KEY_METHOD, Rule, anonymize
from tablekit.plans import limits
from tablekit.plans.naming import unique_file_names
from tablekit.sources import storage
from tablekit.sources.catalog import Catalog


def copy_lines(df: DataFrame, *keep: str, micros: bool = False) -> DataFrame:
    """One COPY data ``line`` per row; ``keep`` names columns to carry along.

    Instants are cut to milliseconds, unless ``micros`` asks for all of them.
    """
    cells = [rendering.copy_cell(F.col(f"`{f.name}`"), f.dataType, micros) for f in df.schema.fields]
    return df.select(*keep, F.concat_ws("\t", *cells).alias("line"))


def copy_header(table: str, columns: list[str]) -> str:
    names = ", ".join(rendering.quote_identifier(c, rendering.POSTGRES) for c in columns)
    return f"COPY {rendering.quote_identifier(table, rendering.POSTGRES)} ({names}) FROM stdin;"


def copy_rows(lines: DataFrame, schema: T.StructType, misfits: bool = False) -> DataFrame:
    """Typed rows of COPY data lines (column ``line``); inverse of :func:`copy_lines`.

    ``misfits`` adds a column with the names of those columns whose cell doesn't fit, as
    null there; a line of another number of cells fits no column.
    """
    cells = lines.select(F.split(F.col("line"), "\t", -1).alias("cells"))

    def text(i: int, data_type: T.DataType) -> Column:
        return rendering.copy_cell_text(F.get(F.col("cells"), F.lit(i)), data_type)

    rows = typed_cells(cells, schema, text)
    return rows if misfits else rows.drop(MISFITS)


MISFITS = "_misfits"


def typed_cells(
    cells: DataFrame, schema: T.StructType, text: Callable[[int, T.DataType], Column]
) -> DataFrame:
    """Typed columns, and the names of those that don't fit, of rows of ``cells``."""
    fields = list(enumerate(schema.fields))
    texts = cells.select(
        *[text(i, f.dataType).alias(f"_text_{i}") for i, f in fields],
        (F.size("cells") == len(fields)).alias("_whole"),
    )
    typed = texts.select(
        *[F.when(F.col("_whole"), _typed(F.col(f"_text_{i}"), f.dataType)).alias(f"_value_{i}") for i, f in fields],
        *[f"_text_{i}" for i, _ in fields],
        "_whole",
    )
    wrong = [
        F.when(~F.col("_whole") | (F.col(f"_value_{i}").isNull() & F.col(f"_text_{i}").isNotNull()), F.lit(f.name))
        for i, f in fields
    ]
    return typed.select(
        *[F.col(f"_value_{i}").alias(f.name) for i, f in fields], F.array_compact(F.array(*wrong)).alias(MISFITS)
    )


def misfit_counts(rows: DataFrame) -> DataFrame:
    """Rows with a misfit, by column, of rows that were read with their misfits."""
    names = rows.select(F.explode(MISFITS).alias("column_name"))
    return names.groupBy("column_name").agg(F.count(F.lit(1)).alias("misfits"))


def _typed(text: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, kinds.TIMESTAMP_TYPES):
        # The written instant ends in Z; a type without zone takes it as it stands.
        return F.rtrim(text, F.lit("Z")).try_cast(data_type)
    if isinstance(data_type, T.DateType):
        return F.substring(text, 1, 10).try_cast(data_type)
    if isinstance(data_type, kinds.FRACTIONAL_TYPES):
        return text.try_cast(data_type)
    if isinstance(data_type, T.BinaryType):
        return F.unbase64(text)
    return parsing.typed_value(text, data_type)


def numbered_rows(
    df: DataFrame, order: list[str], unique: bool, *payload: Column, stage: storage.Stage | None = None
) -> DataFrame:
    """``payload`` of every row and its 0-based ``_index`` in the given order.

    Rows are range-partitioned and sorted, then their payload is staged with
    partition and place, and every place is raised by the sizes of the partitions
    before it. Only those sizes, one row per partition, meet in one task. Where
    the order does not tell rows apart, the scan position splits equal rows over
    partitions; such rows have to come from a scan and projections of it, which a
    repeated task reads alike.
    """
    keys = [F.col(f"`{name}`") for name in order]
    if not unique:
        df = df.withColumn("_scan", F.monotonically_increasing_id())
        keys.append(F.col("_scan"))
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = (stage or storage.Stage()).table(
        ordered.select(*payload, F.spark_partition_id().alias("_part"), place.alias("_place")), "ordered"
    )
    starts = partition_starts(placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size")))
    return placed.join(F.broadcast(starts), "_part").select(
        *[F.col(f"`{c}`") for c in placed.columns if c not in ("_part", "_place")],
        (F.col("_start") + F.col("_place")).alias("_index"),
    )


def partition_starts(sizes: DataFrame) -> DataFrame:
    """Rows before each partition, from one row per partition (``_part, _size``)."""
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_size").over(before), F.lit(0)).cast("bigint")
    return sizes.select("_part", start.alias("_start"))


def insert_heads(table: str, columns: list[str], dialect: str) -> tuple[str, str]:
    """What an INSERT starts with, with and without the names of its columns."""
    names = ", ".join(rendering.quote_identifier(c, dialect) for c in columns)
    into = f"INSERT INTO {rendering.quote_identifier(table, dialect)}"
    return f"{into} ({names}) VALUES", f"{into} VALUES"


def insert_statements(
    df: DataFrame,
    table: str,
    dialect: str,
    key: tuple[str, ...] = (),
    batch_rows: int = limits.INSERT_BATCH,
    stage: storage.Stage | None = None,
    micros: bool = False,
) -> DataFrame:
    """``batch`` and ``statement``: multi-row INSERTs in key order, the last one partial.

    Without a key, rows are ordered by all columns that can be compared. Instants are cut
    to milliseconds, unless ``micros`` asks for all of them.
    """
    if dialect not in rendering.DIALECTS:
        raise ValueError(f"Unknown dialect: {dialect}")
    sortable = [f.name for f in df.schema.fields if kinds.is_orderable(f.dataType)]
    order = list(key) or sortable
    literals = [
        rendering.sql_literal(F.col(f"`{f.name}`"), f.dataType, dialect, micros) for f in df.schema.fields
    ]
    values = F.concat(F.lit("("), F.concat_ws(", ", *literals), F.lit(")"))
    numbered = numbered_rows(df, order, bool(key), values.alias("_values"), stage=stage)
    head = insert_heads(table, df.columns, dialect)[0] + " "
    batches = numbered.groupBy(
        F.floor(F.col("_index") / F.lit(batch_rows)).cast("bigint").alias("batch")
    ).agg(F.sort_array(F.collect_list(F.struct("_index", "_values"))).alias("rows"))
    return batches.select(
        "batch",
        F.concat(
            F.lit(head), F.array_join(F.col("rows").getField("_values"), ", "), F.lit(";")
        ).alias("statement"),
    )


def render(
    df: DataFrame,
    table: str,
    dialect: str,
    key: tuple[str, ...] = (),
    stage: storage.Stage | None = None,
) -> DataFrame:
    """Dump lines in the fastest load format of a dialect, as a ``line`` column."""
    if dialect == rendering.POSTGRES:
        return copy_lines(df)
    statements = insert_statements(df, table, dialect, key, stage=stage)
    return statements.select(F.col("statement").alias("line"))


def manifest(catalog: Catalog, rules: list[Rule], seed: int | str, tables: list[str] | None = None) -> DataFrame:
    """One row per dumped table: rows, rules that apply, seed and whether it is empty."""
    chosen = catalog.select(tables)
    rows = [
        chosen.table(name)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.lit(sum(rule.table == name for rule in rules)).cast("bigint").alias("rule_count"),
            F.lit(str(seed)).alias("seed"),
            (F.col("row_count") == 0).alias("is_empty"),
        )
        for name in chosen.names
    ]
    if not rows:
        raise ValueError("No table to dump.")
    return reduce(DataFrame.unionByName, rows)


def anonymized_dump(
    catalog: Catalog,
    rules: list[Rule],
    out: str,
    dialect: str,
    seed: int | str,
    tables: list[str] | None = None,
) -> DataFrame:
    """Write every chosen table, anonymized, under ``out`` and return the manifest.

    A table folder holds ``1_header``, ``2_data`` and ``3_footer`` text, which put
    together in that order load the table. Tables without rows get no folder.
    """
    if not rules:
        raise ValueError("An anonymized dump needs at least one rule.")
    chosen = catalog.select(tables)
    listing = storage.checkpointed(manifest(catalog, rules, seed, tables))
    filled = {row["table_name"] for row in listing.where(~F.col("is_empty")).collect()}
    for name, folder in zip(chosen.names, unique_file_names(chosen.names, ""), strict=True):
        if name not in filled:
            continue
        replaced = anonymize(chosen.table(name), name, rules, seed)
        target = f"{out}/{folder}"
        key = chosen.contract(name).primary_key
        if any(rule.table == name and rule.column in key and rule.method != KEY_METHOD for rule in rules):
            key = ()  # replaced key values may repeat
        with storage.Stage() as stage:
            render(replaced, name, dialect, key, stage).write.text(f"{target}/2_data")
        if dialect == rendering.POSTGRES:
            _write_line(listing.sparkSession, copy_header(name, replaced.columns), f"{target}/1_header")
            _write_line(listing.sparkSession, rendering.COPY_END, f"{target}/3_footer")
    listing.coalesce(1).write.option("header", True).csv(f"{out}/manifest")
    return listing


def _write_line(spark: SparkSession, line: str, path: str) -> None:
    spark.range(1).select(F.lit(line).alias("line")).coalesce(1).write.text(path)
