"""Registered queries: pages, charts, counts, keys and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.functions.kinds import kind_from_type_name
from tablekit.operators import mutate, quality, view
from tablekit.operators.chart import chart
from tablekit.plans.contract import ForeignKey
from tablekit.plans.requests import ChartRequest, Filter, PageRequest, Sort
from tablekit.registry.base import FOREIGN_KEYS, PRIMARY_KEYS, TABLES, Query, contract, open_catalog


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return open_catalog(spark, folder).table(name)


# ------------------------------------------------------------------- charts

CHART_SQL = """
WITH cut AS (
  SELECT {bucket} AS bucket, {value} AS value FROM {source} GROUP BY 1
  ORDER BY {order} LIMIT {extra}
), ranked AS (
  SELECT row_number() OVER (ORDER BY {order}) AS rank, count(*) OVER () AS fetched,
    coalesce({label}, '(null)') AS x,
    CAST(value AS DOUBLE) AS y
  FROM cut
), placed AS (
  SELECT CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS position, x,
    round(y, {digits}) AS y, fetched > {limit} AS truncated
  FROM ranked WHERE y IS NOT NULL
)
SELECT position, x, y, truncated FROM placed WHERE position <= {limit}
"""

BUCKETS = {"hour": "%Y-%m-%d %H:00:00", "day": "%Y-%m-%d", "month": "%Y-%m-01"}


def _chart_sql(source: str, bucket: str, value: str, limit: int = 120, grain: str | None = None, digits: int = 2) -> str:
    if grain:
        order = "bucket ASC NULLS FIRST"
        bucket, label = f"date_trunc('{grain}', {bucket})", f"strftime(bucket, '{BUCKETS[grain]}')"
    else:
        order, label = "value DESC NULLS LAST, bucket ASC NULLS FIRST", "CAST(bucket AS VARCHAR)"
    return CHART_SQL.format(
        source=source, bucket=bucket, value=value, order=order, label=label, limit=limit, extra=limit + 1, digits=digits
    )


def _charted(df: DataFrame, request: ChartRequest, digits: int = 2) -> DataFrame:
    return chart(df, request.table, request).withColumn("y", F.round("y", digits))


def _chart_of(request: ChartRequest, digits: int = 2):
    return lambda spark, folder: _charted(_table(spark, folder, request.table), request, digits)


def _with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Events without the value of every click and the type of every error."""
    events = _table(spark, folder, "events")
    return events.select(
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"),
        F.when(F.col("event_type") != "click", F.col("value")).alias("value"),
    )


GAPS_SQL = """(SELECT CASE WHEN event_type <> 'error' THEN event_type END AS event_type,
  CASE WHEN event_type <> 'click' THEN value END AS value FROM events)"""


def _chart_long_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _charted(
        _table(spark, folder, "documents"),
        ChartRequest("documents", "max", metric="n_chars", dimension="text", limit=500),
    )


# -------------------------------------------------------------------- pages


def _page_of(request: PageRequest):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = _table(spark, folder, request.table)
        return view.table_page(df, contract(request.table, df), request).rows

    return run


def _flags(spark: SparkSession, folder: str) -> DataFrame:
    labels = _table(spark, folder, "labels")
    return labels.select("doc_id", "quality", (F.col("toxic") == 1).alias("toxic"))


def _page_filter_bool(spark: SparkSession, folder: str) -> DataFrame:
    flags = _flags(spark, folder)
    request = PageRequest("labels", 0, 200, filters=[Filter("toxic", "YES")])
    return view.table_page(flags, contract("labels", flags), request).rows


def _page_total(spark: SparkSession, folder: str) -> DataFrame:
    orders = _table(spark, folder, "orders")
    request = PageRequest("orders", 3, 40, filters=[Filter("o_orderstatus", "f")])
    return view.table_page(orders, contract("orders", orders), request).total


def _page_total_empty(spark: SparkSession, folder: str) -> DataFrame:
    orders = _table(spark, folder, "orders")
    request = PageRequest("orders", filters=[Filter("o_orderkey", "1.5")])
    return view.table_page(orders, contract("orders", orders), request).total


def _page_after(spark: SparkSession, folder: str) -> DataFrame:
    customer = _table(spark, folder, "customer")
    declared = contract("customer", customer)
    request = PageRequest("customer", page_size=50, sorts=[Sort("c_mktsegment"), Sort("c_acctbal", True)])
    first = view.table_page(customer, declared, request)
    last = first.rows.orderBy(F.desc("c_mktsegment"), "c_acctbal", F.desc("c_custkey")).first().asDict()
    return view.page_rows_after(customer, first.page, last, declared.primary_key)


# --------------------------------------------------------- counts and checks


def _row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return quality.table_row_counts(open_catalog(spark, folder))


def _profile(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = _table(spark, folder, name)
        if name == "events":
            df = df.withColumn("value", F.nullif(F.col("value"), F.lit(6.55)))
        return quality.table_profile(df, contract(name, df))

    return run


def _profile_sql(table: str, columns: list[tuple[str, str, str]], key: tuple[str, ...]) -> str:
    source = table
    if table == "events":
        source = "(SELECT * REPLACE (nullif(value, 6.55) AS value) FROM events)"
    parts = [
        f"""SELECT '{table}' AS table_name, CAST({i} AS BIGINT) AS ordinal, '{name}' AS column_name,
  '{kind_name}' AS data_type, '{kind}' AS kind, {str(name not in key).lower()} AS is_nullable,
  {str(name in key).lower()} AS is_primary_key, false AS is_auto_increment, count(*) AS row_count,
  count(*) - count({name}) AS null_count, '{kind}' AS kind_of_type_name FROM {source}"""
        for i, (name, kind_name, kind) in enumerate(columns, 1)
    ]
    return "\nUNION ALL\n".join(parts)


CUSTOMER_COLUMNS = [
    ("c_custkey", "bigint", "numeric"),
    ("c_name", "string", "categorical"),
    ("c_nationkey", "int", "numeric"),
    ("c_acctbal", "double", "numeric"),
    ("c_mktsegment", "string", "categorical"),
]
EVENT_COLUMNS = [
    ("event_id", "bigint", "numeric"),
    ("ts", "timestamp_ntz", "temporal"),
    ("user_id", "bigint", "numeric"),
    ("event_type", "string", "categorical"),
    ("value", "double", "numeric"),
    ("props", "string", "categorical"),
]


def _type_name_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds by type name, of the event types and customer segments as names."""
    events = _table(spark, folder, "events").select(F.col("event_type").alias("type_name"))
    segments = _table(spark, folder, "customer").select(F.col("c_mktsegment").alias("type_name"))
    names = events.unionByName(segments).groupBy("type_name").agg(F.count(F.lit(1)).alias("n"))
    return names.select("type_name", kind_from_type_name(F.col("type_name")).alias("kind"), "n")


TYPE_NAME_KINDS_SQL = """
WITH names AS (
  SELECT type_name, count(*) AS n FROM (
    SELECT event_type AS type_name FROM events UNION ALL SELECT c_mktsegment FROM customer)
  GROUP BY 1)
SELECT type_name,
  CASE WHEN regexp_matches(lower(type_name), 'int|numeric|decimal|real|double|float|serial') THEN 'numeric'
       WHEN regexp_matches(lower(type_name), 'date|time') THEN 'temporal'
       WHEN regexp_matches(lower(type_name), 'bool') OR lower(type_name) IN ('tinyint(1)', 'bit') THEN 'boolean'
       WHEN trim(type_name) <> '' THEN 'categorical' ELSE 'unknown' END AS kind, n
FROM names
"""


def _key_report(spark: SparkSession, folder: str) -> DataFrame:
    """Lineitem under a key that does not hold, orders under one that does."""
    catalog = open_catalog(spark, folder)
    lineitem = catalog.table("lineitem")
    declared = contract("lineitem", lineitem)
    claimed = type(declared)("lineitem", lineitem.schema, ("l_orderkey", "l_linenumber"))
    return quality.key_report(lineitem, claimed).unionByName(
        quality.key_report(catalog.table("orders"), catalog.contract("orders"))
    )


KEY_REPORT_SQL = """
WITH li AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber),
     o AS (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)
SELECT 'lineitem' AS table_name, 'l_orderkey,l_linenumber' AS key, CAST(sum(n) AS BIGINT) AS row_count,
  CAST(0 AS BIGINT) AS null_key_rows, CAST(count(*) FILTER (n > 1) AS BIGINT) AS duplicate_keys,
  CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM li
UNION ALL
SELECT 'orders', 'o_orderkey', CAST(sum(n) AS BIGINT), CAST(0 AS BIGINT),
  CAST(count(*) FILTER (n > 1) AS BIGINT), CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM o
"""


def _some_customers(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "customer").where(F.col("c_mktsegment") != "BUILDING")


def _orphan_report(spark: SparkSession, folder: str) -> DataFrame:
    """All declared references, and orders against customers outside one segment."""
    declared = quality.reference_report(open_catalog(spark, folder))
    key = ForeignKey("o_custkey", "other_customers", "c_custkey")
    thinned = quality.orphan_report(
        _table(spark, folder, "orders"), "orders", key, _some_customers(spark, folder)
    )
    return declared.unionByName(thinned)


def _orphan_sql() -> str:
    parts = []
    for table, keys in FOREIGN_KEYS.items():
        for k in keys:
            parts.append((table, k.column, f"{k.ref_table}.{k.ref_column}", k.ref_table, k.ref_column))
    others = "(SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING')"
    parts.append(("orders", "o_custkey", "other_customers.c_custkey", others, "c_custkey"))
    return "\nUNION ALL\n".join(
        f"""SELECT '{table}' AS table_name, '{column}' AS column_name, '{name}' AS reference,
  count(DISTINCT {column}) AS orphan_values, count(*) AS orphan_rows FROM {table}
  WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT p.{ref} FROM {parent} p WHERE p.{ref} IS NOT NULL)"""
        for table, column, name, parent, ref in parts
    )


def _orphan_rows(spark: SparkSession, folder: str) -> DataFrame:
    key = ForeignKey("o_custkey", "customer", "c_custkey")
    return quality.orphan_rows(_table(spark, folder, "orders"), key, _some_customers(spark, folder))


def _child_counts(spark: SparkSession, folder: str) -> DataFrame:
    catalog = open_catalog(spark, folder)
    return quality.child_counts(catalog.table("nation"), "n_nationkey", catalog.table("customer"), "c_nationkey")


def _child_counts_orders(spark: SparkSession, folder: str) -> DataFrame:
    catalog = open_catalog(spark, folder)
    return quality.child_counts(catalog.table("customer"), "c_custkey", catalog.table("orders"), "o_custkey")


MAX_KEYS = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey"}


def _max_keys(spark: SparkSession, folder: str) -> DataFrame:
    return quality.next_key_values(open_catalog(spark, folder), MAX_KEYS)


def _row_keys(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = _table(spark, folder, name)
        key = PRIMARY_KEYS.get(name, ())
        columns = [view.row_key(df.schema, key).alias("row_key")]
        if key:
            columns.append(view.row_identity(key).alias("identity"))
        return df.select(*columns)

    return run


def _writable(spark: SparkSession, folder: str) -> DataFrame:
    orders = _table(spark, folder, "orders")
    return mutate.writable(orders, contract("orders", orders), for_update=True)


def _lineitem_row_key_sql() -> str:
    """JSON text of a lineitem row; doubles print as they do in both engines."""
    numbers = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    wholes = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    columns = sorted(
        [(c, f"CAST({c} AS VARCHAR)") for c in (*numbers, *wholes)]
        + [(c, f"'\"' || {c} || '\"'") for c in ("l_returnflag", "l_linestatus")]
        + [("l_shipdate", "strftime(l_shipdate, '\"%Y-%m-%dT%H:%M:%S.%gZ\"')")]
    )
    body = " || ',' || ".join(f"'\"{name}\":' || {text}" for name, text in columns)
    return f"SELECT 'row:{{' || {body} || '}}' AS row_key FROM lineitem"


def _counted_sql() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}" for name in sorted(TABLES)
    )


ALL_LINEITEM = ("l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
                "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate")


def _ascending(columns: str) -> str:
    return ", ".join(f"{c.strip()} ASC NULLS FIRST" for c in columns.split(","))


QUERIES = [
    Query(
        "chart_sum_by_status",
        _chart_of(ChartRequest("orders", "sum", metric="o_totalprice", dimension="o_orderstatus")),
        _chart_sql("orders", "o_orderstatus", "sum(o_totalprice)"),
    ),
    Query(
        "chart_count_by_dimension_truncated",
        _chart_of(ChartRequest("part", "count", dimension="p_brand", limit=5)),
        _chart_sql("part", "p_brand", "count(*)", 5),
    ),
    Query(
        "chart_count_metric",
        lambda spark, folder: _charted(
            _with_gaps(spark, folder), ChartRequest("events", "count", metric="value", dimension="event_type")
        ),
        _chart_sql(GAPS_SQL, "event_type", "count(value)"),
    ),
    Query(
        "chart_avg_by_hour",
        _chart_of(ChartRequest("events", "avg", mode="time", metric="value", time="ts", grain="hour", limit=500), 10),
        _chart_sql("events", "ts", "avg(value)", 500, "hour", 10),
    ),
    Query(
        "chart_max_by_day",
        _chart_of(ChartRequest("orders", "max", mode="time", metric="o_totalprice", time="o_orderdate", limit=9999)),
        _chart_sql("orders", "o_orderdate", "max(o_totalprice)", 9999, "day"),
    ),
    Query(
        "chart_min_by_month",
        _chart_of(ChartRequest("orders", "min", mode="time", chart_type="line", metric="o_totalprice",
                               time="o_orderdate", grain="month")),
        _chart_sql("orders", "o_orderdate", "min(o_totalprice)", 120, "month"),
    ),
    Query(
        "chart_null_bucket_and_null_metric",
        lambda spark, folder: _charted(
            _with_gaps(spark, folder),
            ChartRequest("events", "sum", metric="value", dimension="event_type", limit=2),
        ),
        _chart_sql(GAPS_SQL, "event_type", "sum(value)", 2),
    ),
    Query("chart_long_labels", _chart_long_labels, _chart_sql("documents", "text", "max(n_chars)", 500)),
    Query(
        "chart_sum_lineitem_by_part",
        _chart_of(ChartRequest("lineitem", "sum", metric="l_quantity", dimension="l_partkey", limit=25)),
        _chart_sql("lineitem", "l_partkey", "sum(l_quantity)", 25),
    ),
    Query("page_default_sort", _page_of(PageRequest("orders")),
          f"SELECT * FROM orders ORDER BY {_ascending('o_orderkey')} LIMIT 25"),
    Query(
        "page_multi_sort",
        _page_of(PageRequest("lineitem", 4, 50, [Sort("l_shipdate", True), Sort("l_quantity"), Sort("l_tax", True)])),
        f"""SELECT * FROM lineitem ORDER BY l_shipdate DESC NULLS LAST, l_quantity ASC NULLS FIRST,
  l_tax DESC NULLS LAST, {_ascending(ALL_LINEITEM)} LIMIT 50 OFFSET 200""",
    ),
    Query("page_past_end", _page_of(PageRequest("orders", 10_000_000, 200)),
          f"SELECT * FROM orders ORDER BY {_ascending('o_orderkey')} LIMIT 200 OFFSET 2000000000"),
    Query(
        "page_filter_numeric",
        _page_of(PageRequest("lineitem", 0, 200, filters=[Filter("l_suppkey", " 7.0 "), Filter("l_quantity", "2e1")])),
        f"""SELECT * FROM lineitem WHERE l_suppkey = 7 AND l_quantity = 20
  ORDER BY {_ascending(ALL_LINEITEM)} LIMIT 200""",
    ),
    Query(
        "page_many_filters",
        _page_of(PageRequest("lineitem", 0, 1000, filters=[
            *[Filter("l_returnflag", value) for value in ("r", "R", "%", "_", " r ", "R%", "%r", "r")],
            Filter("l_linestatus", "f"), Filter("l_quantity", "20")])),
        f"""SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity = 20
  ORDER BY {_ascending(ALL_LINEITEM)} LIMIT 1000""",
    ),
    Query(
        "page_filter_text",
        _page_of(PageRequest("orders", 1, 30, [Sort("o_totalprice", True)],
                             [Filter("o_orderpriority", "urgent"), Filter("o_orderdate", "1998-1")])),
        """SELECT * FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%'
  AND lower(CAST(o_orderdate AS VARCHAR)) LIKE '%1998-1%'
  ORDER BY o_totalprice DESC NULLS LAST, o_orderkey ASC NULLS FIRST LIMIT 30 OFFSET 30""",
    ),
    Query("page_filter_bool", _page_filter_bool,
          """SELECT doc_id, quality, toxic = 1 AS toxic FROM labels WHERE toxic = 1
  ORDER BY doc_id ASC NULLS FIRST LIMIT 200"""),
    Query(
        "page_filter_wildcard",
        _page_of(PageRequest("customer", 0, 200, filters=[Filter("c_name", "#%1_7"), Filter("c_mktsegment", "B%G")])),
        """SELECT * FROM customer WHERE lower(c_name) LIKE '%#%1_7%' AND lower(c_mktsegment) LIKE '%b%g%'
  ORDER BY c_custkey ASC NULLS FIRST LIMIT 200""",
    ),
    Query("page_keyset", _page_after,
          """SELECT * FROM customer ORDER BY c_mktsegment ASC NULLS FIRST, c_acctbal DESC NULLS LAST,
  c_custkey ASC NULLS FIRST LIMIT 50 OFFSET 50"""),
    Query("page_total", _page_total,
          """SELECT count(*) AS total_rows, CAST(3 AS BIGINT) AS page_index, CAST(40 AS BIGINT) AS page_size,
  CAST(ceil(count(*) / 40.0) AS BIGINT) AS page_count FROM orders WHERE lower(o_orderstatus) LIKE '%f%'"""),
    Query("page_total_empty", _page_total_empty,
          """SELECT count(*) AS total_rows, CAST(0 AS BIGINT) AS page_index, CAST(25 AS BIGINT) AS page_size,
  CAST(ceil(count(*) / 25.0) AS BIGINT) AS page_count FROM orders WHERE o_orderkey = 1.5"""),
    Query("table_row_counts", _row_counts, _counted_sql()),
    Query("table_profile", _profile("customer"), _profile_sql("customer", CUSTOMER_COLUMNS, ("c_custkey",))),
    Query("table_profile_events", _profile("events"), _profile_sql("events", EVENT_COLUMNS, ("event_id",))),
    Query("type_name_kinds", _type_name_kinds, TYPE_NAME_KINDS_SQL),
    Query("key_report", _key_report, KEY_REPORT_SQL),
    Query("orphan_report", _orphan_report, _orphan_sql()),
    Query("orphan_rows", _orphan_rows,
          """SELECT * FROM orders WHERE o_custkey NOT IN
  (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')"""),
    Query("child_counts", _child_counts,
          """SELECT n.*, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS child_count
  FROM nation n"""),
    Query("child_counts_orders", _child_counts_orders,
          """SELECT c.*, coalesce(n, 0) AS child_count FROM customer c
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey"""),
    Query("max_key_per_table", _max_keys, "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, coalesce(max({c}), 1) AS max_key FROM {t}"
        for t, c in MAX_KEYS.items())),
    Query("row_keys", _row_keys("orders"),
          """SELECT 'pk:{"o_orderkey":' || o_orderkey || '}' AS row_key,
  '{"o_orderkey":' || o_orderkey || '}' AS identity FROM orders"""),
    Query("row_keys_composite", _row_keys("conversations"),
          """SELECT 'pk:{"conv_id":' || conv_id || ',"turn":' || turn || '}' AS row_key,
  '{"conv_id":' || conv_id || ',"turn":' || turn || '}' AS identity FROM conversations"""),
    Query("row_keys_without_key", _row_keys("lineitem"), _lineitem_row_key_sql()),
    Query("writable_projection", _writable,
          "SELECT o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"),
]
