"""Registered queries: facts found in the data, and pages far into a table."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.functions import key_cipher
from tablekit.operators import deep_pages, discovery
from tablekit.operators.anonymize import KEY_METHOD, Rule, anonymize
from tablekit.plans.requests import Filter, PageRequest, Sort, resolve_page
from tablekit.registry.base import Query, contract, open_catalog, sql_hash, sql_hex

# ---------------------------------------------------------------------- pages

DEEP = PageRequest("lineitem", 1000, 50, [Sort("l_shipdate", True), Sort("l_quantity")])
COUNTED = PageRequest("orders", 2, 30, [Sort("o_totalprice", True)], [Filter("o_orderstatus", "f")])


def _page_deep(spark: SparkSession, folder: str) -> DataFrame:
    lineitem = open_catalog(spark, folder).table("lineitem")
    page = resolve_page(DEEP, "lineitem", lineitem.schema)
    return deep_pages.deep_page_rows(lineitem, page, most_rows=10_000)


def _page_with_total(spark: SparkSession, folder: str) -> DataFrame:
    orders = open_catalog(spark, folder).table("orders")
    counted = deep_pages.page_with_total(orders, contract("orders", orders), COUNTED)
    return counted.rows.withColumn("total_rows", F.lit(counted.total).cast("bigint"))


# ----------------------------------------------------------------- keys' fakes

SEED, SCOPE = 7, "customers"
KEY_RULES = [
    Rule("customer", "c_custkey", KEY_METHOD, scope=SCOPE),
    Rule("orders", "o_custkey", KEY_METHOD, scope=SCOPE),
    Rule("orders", "o_orderkey", KEY_METHOD),
]


def _anon_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and their customers, both anonymized, joined by the fakes of their keys."""
    catalog = open_catalog(spark, folder)
    orders = anonymize(catalog.table("orders"), "orders", KEY_RULES, SEED)
    customer = anonymize(catalog.table("customer"), "customer", KEY_RULES, SEED)
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return joined.select("o_orderkey", "c_custkey", "c_name", "o_totalprice")


def _sql_permuted(name: str, source: str, key: str, domain: tuple[str, ...]) -> str:
    """CTEs that end in ``name``: each ``key`` and its ``fake``."""
    steps = [f"{name}_0 AS (SELECT {key} AS key, ({key} >> 32) & 4294967295 AS l, {key} & 4294967295 AS r FROM {source})"]
    for turn in range(key_cipher.ROUNDS):
        h = sql_hash(domain, f"'{turn}' || chr(31) || CAST(r AS VARCHAR)")
        steps.append(f"{name}_{turn + 1} AS (SELECT key, r AS l, xor(l, {sql_hex(h, 1)}) AS r FROM {name}_{turn})")
    steps.append(
        f"""{name} AS (SELECT key, CAST((CASE WHEN l >= 2147483648 THEN l - 4294967296 ELSE l END)::HUGEINT * 4294967296 + r
  AS BIGINT) AS fake FROM {name}_{key_cipher.ROUNDS})"""
    )
    return ",\n".join(steps)


ANON_KEYS_SQL = f"""
WITH {_sql_permuted("buyers", "customer", "c_custkey", (str(SEED), SCOPE))},
{_sql_permuted("bought", "orders", "o_orderkey", (str(SEED), "orders", "o_orderkey"))}
SELECT bought.fake AS o_orderkey, buyers.fake AS c_custkey, c_name, o_totalprice
FROM orders JOIN bought ON bought.key = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN buyers ON buyers.key = c_custkey
"""

# ------------------------------------------------------------------- discovery

COLUMNS = {
    "customer": {"whole": ["c_custkey", "c_nationkey"], "text": ["c_name", "c_mktsegment"]},
    "documents": {"whole": ["doc_id", "n_chars"], "text": ["text", "lang", "source"]},
    "labels": {"whole": ["doc_id", "quality", "toxic"]},
    "lineitem": {
        "whole": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
        "text": ["l_returnflag", "l_linestatus"],
        "time": ["l_shipdate"],
    },
    "nation": {"whole": ["n_nationkey", "n_regionkey"], "text": ["n_name"]},
    "orders": {"whole": ["o_orderkey", "o_custkey"], "text": ["o_orderstatus", "o_orderpriority"], "time": ["o_orderdate"]},
    "part": {"whole": ["p_partkey", "p_size"], "text": ["p_name", "p_brand", "p_type"]},
    "region": {"whole": ["r_regionkey"], "text": ["r_name"]},
    "supplier": {"whole": ["s_suppkey", "s_nationkey"], "text": ["s_name"]},
}


def _catalog(spark: SparkSession, folder: str):
    return open_catalog(spark, folder).select(list(COLUMNS))


def _references_sql() -> str:
    values = "\n  UNION ALL\n".join(
        f"  SELECT '{t}' AS t, '{c}' AS c, '{kind}' AS k, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 4"
        for t, kinds in COLUMNS.items()
        for kind, names in kinds.items()
        for c in names
    )
    counts = " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS total FROM {t}" for t in COLUMNS)
    return f"""
WITH vals AS (
{values}
), facts AS (
  SELECT t, c, count(*) AS d, sum(n) AS filled, max(n) AS most FROM vals GROUP BY t, c
), keys AS (
  SELECT t, c, d FROM facts JOIN ({counts}) USING (t) WHERE most = 1 AND filled = total
), met AS (
  SELECT a.t, a.c, b.t AS rt, b.c AS rc, count(*) AS m
  FROM vals a JOIN vals b ON a.k = b.k AND a.v = b.v AND (a.t <> b.t OR a.c <> b.c) JOIN keys ON keys.t = b.t AND keys.c = b.c
  GROUP BY ALL
)
SELECT met.t AS table_name, met.c AS column_name, rt AS ref_table, rc AS ref_column, m AS distinct_values,
  CAST(m AS DOUBLE) / keys.d AS coverage
FROM met JOIN facts ON facts.t = met.t AND facts.c = met.c AND facts.d = m JOIN keys ON keys.t = rt AND keys.c = rc
"""


def _keys_sql() -> str:
    parts = []
    for t, kinds in COLUMNS.items():
        names = [c for group in kinds.values() for c in group]
        order = {c: i for i, c in enumerate(_COLUMN_ORDER[t])}
        names.sort(key=order.__getitem__)
        full = {c: f"count({c}) = count(*)" for c in names}
        ones = [f"('{c}', count(DISTINCT {c}) = count(*) AND {full[c]})" for c in names]
        twos = [
            f"('{a},{b}', count(DISTINCT ({a}, {b})) = count(*) AND {full[a]} AND {full[b]})" for a, b in combinations(names, 2)
        ]
        tests = lambda entries: "[" + ", ".join(f"{{'k': {e[1:].split(', ', 1)[0]}, 'ok': {e[:-1].split(', ', 1)[1]}}}" for e in entries) + "]"
        parts.append(f"SELECT '{t}' AS t, count(*) AS n, {tests(ones)} AS ones, {tests(twos)} AS twos FROM {t}")
    return f"""
WITH tested AS ({" UNION ALL ".join(parts)}), picked AS (
  SELECT t, n, list_filter(ones, lambda x: x.ok) AS ones, list_filter(twos, lambda x: x.ok) AS twos FROM tested
), chosen AS (
  SELECT t, unnest(CASE WHEN len(ones) > 0 THEN ones ELSE twos END) AS x FROM picked WHERE n > 0
)
SELECT t AS table_name, x.k AS key, CAST(1 + length(x.k) - length(replace(x.k, ',', '')) AS INTEGER) AS n_columns FROM chosen
"""


# The columns above in the order of their tables.
_COLUMN_ORDER = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "labels": ["doc_id", "quality", "toxic"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "region": ["r_regionkey", "r_name"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey"],
}

LINEITEM_ORDER = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
)

QUERIES = [
    Query(
        "page_deep",
        _page_deep,
        f"SELECT * FROM lineitem ORDER BY l_shipdate DESC NULLS LAST, l_quantity, {LINEITEM_ORDER} LIMIT 50 OFFSET 50000",
    ),
    Query(
        "page_with_total",
        _page_with_total,
        """SELECT *, (SELECT count(*) FROM orders WHERE lower(o_orderstatus) LIKE '%f%') AS total_rows FROM orders
  WHERE lower(o_orderstatus) LIKE '%f%' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 30 OFFSET 60""",
    ),
    Query("anon_keys", _anon_keys, ANON_KEYS_SQL),
    Query(
        "discovered_references",
        lambda spark, folder: discovery.discovered_references(_catalog(spark, folder)),
        _references_sql(),
    ),
    Query("discovered_keys", lambda spark, folder: discovery.discovered_keys(_catalog(spark, folder)), _keys_sql()),
]
