"""Registered queries: tables that change as a whole, and restored dumps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.functions import fakes, rendering
from tablekit.operators import dump, ingest, mutate, normalize, rewrite
from tablekit.plans.naming import auto_map
from tablekit.registry import writes
from tablekit.registry.base import PRIMARY_KEYS, Query, open_catalog, sql_hex, sql_iso, sql_number
from tablekit.sources import storage
from tablekit.sources.copy_text import read_copy_text
from tablekit.sources.csv_files import csv_texts, read_csv_text, write_csv, write_database
from tablekit.sources.insert_text import read_insert_text
from tablekit.sources.versions import Versions

# --------------------------------------------------------------- flat to tables

ENTITIES = [
    normalize.Entity(
        "orders", ("o_orderkey",), ("o_orderstatus", "o_orderpriority", "o_totalprice"), ("customer",), frozenset({"customer"})
    ),
    normalize.Entity("customer", ("c_name",), ("c_mktsegment", "c_acctbal"), ("nation",), frozenset({"nation"})),
    normalize.Entity("nation", ("n_name",), ("n_regionkey",)),
]


def _flat_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One flat row per order, with its customer and nation written out."""
    catalog = open_catalog(spark, folder)
    orders, customer, nation = (catalog.table(n) for n in ("orders", "customer", "nation"))
    flat = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return flat.join(nation, flat["c_nationkey"] == nation["n_nationkey"])


def _normalize_flat_orders(spark: SparkSession, folder: str) -> DataFrame:
    """The published tables, one below the other."""
    versions = Versions(spark, storage.new_folder(spark, "normalized"))
    normalize.normalize_flat(_flat_orders(spark, folder), ENTITIES).publish(versions)

    def shown(table: str, parent: str | None, key: str, texts: list[str], amount: str | None) -> DataFrame:
        return versions.table(table).select(
            F.lit(table).alias("table_name"),
            F.col(f"{table}_id").alias("id"),
            (F.col(f"{parent}_id") if parent else F.lit(None).cast("string")).alias("parent_id"),
            F.col(key).cast("string").alias("natural_key"),
            F.concat_ws("|", *[F.col(c).cast("string") for c in texts]).alias("attributes"),
            (F.col(amount) if amount else F.lit(None)).cast("double").alias("amount"),
        )

    return reduce(
        DataFrame.unionByName,
        [
            shown("nation", None, "n_name", ["n_regionkey"], None),
            shown("customer", "nation", "c_name", ["c_mktsegment"], "c_acctbal"),
            shown("orders", "customer", "o_orderkey", ["o_orderstatus", "o_orderpriority"], "o_totalprice"),
        ],
    )


def _surrogate(table: str, key: str) -> str:
    text = f"CAST({key} AS VARCHAR)"
    return f"md5('{table}:' || length({text}) || ':' || {text})"


NORMALIZE_SQL = f"""
WITH flat AS (
  SELECT * FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)
SELECT DISTINCT 'nation' AS table_name, {_surrogate("nation", "n_name")} AS id, CAST(NULL AS VARCHAR) AS parent_id,
  n_name AS natural_key, CAST(n_regionkey AS VARCHAR) AS attributes, CAST(NULL AS DOUBLE) AS amount FROM flat
UNION ALL
SELECT DISTINCT 'customer', {_surrogate("customer", "c_name")}, {_surrogate("nation", "n_name")}, c_name, c_mktsegment,
  c_acctbal FROM flat
UNION ALL
SELECT DISTINCT 'orders', {_surrogate("orders", "o_orderkey")}, {_surrogate("customer", "c_name")},
  CAST(o_orderkey AS VARCHAR), o_orderstatus || '|' || o_orderpriority, o_totalprice FROM flat
"""


def _normalize_flat_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """What is found where every 13th order spells its customer's segment differently."""
    flat = _flat_orders(spark, folder)
    key = F.col("o_orderkey")
    spoilt = flat.withColumns(
        {
            "c_mktsegment": F.when(key % 13 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")),
            "n_name": F.when(key % 101 != 0, F.col("n_name")),
        }
    )
    return normalize.normalize_flat(spoilt, ENTITIES).conflicts


CONFLICTS_SQL = f"""
WITH flat AS (
  SELECT * EXCLUDE (c_mktsegment, n_name),
    CASE WHEN o_orderkey % 13 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment,
    CASE WHEN o_orderkey % 101 <> 0 THEN n_name END AS n_name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), kept AS (
  SELECT DISTINCT {_surrogate("customer", "c_name")} AS surrogate, {_surrogate("nation", "n_name")} AS nation_id,
    c_mktsegment, c_acctbal FROM flat
)
SELECT 'customer' AS table_name, surrogate,
  CASE WHEN count(*) > 1 THEN 'One key with unlike attributes.' ELSE 'Row without a parent.' END AS reason,
  count(*) AS variants
FROM kept GROUP BY surrogate HAVING count(*) > 1 OR bool_or(nation_id IS NULL)
"""


# --------------------------------------------------------------- restored dumps


def _insert_round_trip(name: str, dialect: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = open_catalog(spark, folder).table(name)
        out = storage.new_folder(spark, "insert")
        lines = dump.insert_statements(df, name, dialect, PRIMARY_KEYS[name], micros=True)
        lines.select("statement").write.option("lineSep", "\n").text(out)
        return read_insert_text(spark, out, name, df.schema, dialect)

    return run


def _copy_round_trip_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as COPY text and back, instants to the microsecond."""
    df = open_catalog(spark, folder).table("events")
    out = storage.new_folder(spark, "copy")
    dump.copy_lines(df, micros=True).write.option("lineSep", "\n").text(out)
    return read_copy_text(spark, out, "events", df.schema)


def _restore_misfits(spark: SparkSession, folder: str) -> DataFrame:
    """Misfits by column where statuses were dumped as prices, and some lines are short."""
    orders = open_catalog(spark, folder).table("orders")
    key = F.col("o_orderkey")
    spoilt = orders.withColumn(
        "o_totalprice", F.when(key % 7 == 0, F.col("o_orderstatus")).otherwise(F.col("o_custkey").cast("string"))
    )
    short = F.when(key % 11 == 0, F.substring_index("line", "\t", 3)).otherwise(F.col("line"))
    lines = dump.copy_lines(spoilt, "o_orderkey").select(short.alias("line"))
    return dump.misfit_counts(dump.copy_rows(lines, orders.schema, misfits=True))


MISFITS_SQL = """
WITH short AS (SELECT count(*) FILTER (o_orderkey % 11 = 0) AS n,
  count(*) FILTER (o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0) AS wrong FROM orders)
SELECT column_name, CASE WHEN column_name = 'o_totalprice' THEN n + wrong ELSE n END AS misfits
FROM short, (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority'])
  AS column_name)
"""


# ------------------------------------------------------------ exported database

# All columns of all tables, but for vectors and numbers with many digits.
EXPORTED = {
    "benchmark": ["item_id", "text"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "label"],
    "events": ["event_id", "ts", "user_id", "event_type", "props"],
    "labels": ["doc_id", "quality", "toxic"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "pages": ["page_id", "url", "html"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "region": ["r_regionkey", "r_name"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
}
DECIMALS = {
    "c_acctbal", "s_acctbal", "o_totalprice", "p_retailprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
}
INSTANTS = {"ts", "o_orderdate", "l_shipdate"}


def _csv_database_content(spark: SparkSession, folder: str) -> DataFrame:
    """Per exported table its records and a hash of all their cells, in any order."""
    out = storage.new_folder(spark, "database")
    folders = write_database(open_catalog(spark, folder), out)
    hashes = []
    for name, columns in EXPORTED.items():
        cells = read_csv_text(spark, f"{out}/{folders[name]}")
        row = F.md5(F.concat_ws(fakes.SEPARATOR, *[F.col(c) for c in columns]))
        hashes.append(
            cells.agg(
                F.count(F.lit(1)).alias("row_count"),
                F.coalesce(F.sum(fakes.hex_number(row, 1)), F.lit(0)).alias("content_hash"),
            ).select(F.lit(name).alias("table_name"), "row_count", "content_hash")
        )
    return reduce(DataFrame.unionByName, hashes)


def _content_sql(name: str, columns: list[str]) -> str:
    def cell(c: str) -> str:
        text = sql_number(c) if c in DECIMALS else sql_iso(c) if c in INSTANTS else f"CAST({c} AS VARCHAR)"
        return f"coalesce({text}, '')"

    row = f"md5(concat_ws(chr(31), {', '.join(map(cell, columns))}))"
    return f"""SELECT '{name}' AS table_name, count(*) AS row_count,
  CAST(coalesce(sum({sql_hex(row, 1)}), 0) AS BIGINT) AS content_hash FROM {name}"""


# ------------------------------------------------------------- versioned tables


def _apply_updates_files(spark: SparkSession, folder: str) -> DataFrame:
    """The updates of ``apply_updates`` on a table in files by ranges of its key."""
    catalog = open_catalog(spark, folder)
    versions = Versions(spark, storage.new_folder(spark, "versions"))
    rewrite.create(versions, "orders", catalog.table("orders"), ["o_orderkey"], files=8)
    checked, declared = writes.validated_updates(catalog)
    rewrite.update_files(versions, "orders", mutate.latest_patch(checked, declared, "round"), declared)
    return versions.table("orders")


def _import_written(table: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        versions = Versions(spark, storage.new_folder(spark, "versions"))
        rewrite.publish_import(writes.imported(spark, folder), versions, "orders")
        return versions.table(table)

    return run


def _import_missing_required(spark: SparkSession, folder: str) -> DataFrame:
    """Orders imported without their customer, which is required."""
    catalog = open_catalog(spark, folder)
    out, declared = storage.new_folder(spark, "csv"), catalog.contract("orders")
    texts = csv_texts(catalog.table("orders"))
    write_csv(texts, out)
    mapping = {h: c for h, c in auto_map(texts.columns, declared.columns).items() if c != "o_custkey"}
    return ingest.import_csv(spark, out, declared, mapping, multi_line=False).rejects


MISSING_SQL = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
  {sql_number("o_totalprice")} AS o_totalprice, {sql_iso("o_orderdate")} AS o_orderdate, o_orderpriority,
  'Missing value in required column o_custkey.' AS _error_reason
FROM orders
"""

QUERIES = [
    Query("normalize_flat_orders", _normalize_flat_orders, NORMALIZE_SQL),
    Query("normalize_flat_conflicts", _normalize_flat_conflicts, CONFLICTS_SQL),
    Query("insert_round_trip_documents", _insert_round_trip("documents", rendering.MYSQL), "SELECT * FROM documents"),
    Query("insert_round_trip_orders", _insert_round_trip("orders", rendering.SQLITE), "SELECT * FROM orders"),
    Query("copy_round_trip_events", _copy_round_trip_events, "SELECT * FROM events"),
    Query(
        "csv_database_content",
        _csv_database_content,
        "\nUNION ALL\n".join(_content_sql(name, columns) for name, columns in EXPORTED.items()),
    ),
    Query("restore_misfits", _restore_misfits, MISFITS_SQL),
    Query("apply_updates_files", _apply_updates_files, writes.APPLY_UPDATES_SQL),
    Query("import_written", _import_written("orders"), writes.GOOD_SQL),
    Query("import_written_rejects", _import_written("orders_rejects"), writes.REJECTS_SQL),
    Query("import_missing_required", _import_missing_required, MISSING_SQL),
]
