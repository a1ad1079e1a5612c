"""Registered queries: imports, validated writes and synthetic rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import fakes, parsing, rendering
from tablekit.operators import generate, ingest, mutate, quality
from tablekit.plans.contract import Contract
from tablekit.registry.base import (
    Query,
    contract,
    open_catalog,
    sql_hash,
    sql_hex,
    sql_iso,
    sql_number,
    sql_pick,
)
from tablekit.registry.texts import fake_sql, sentence_sql
from tablekit.sources import storage
from tablekit.sources.catalog import Catalog
from tablekit.sources.csv_files import csv_lines, csv_texts, write_csv
from tablekit.streaming import import_stream

# --------------------------------------------------------------------- import

HEADERS = {
    "o_orderkey": "O-OrderKey",
    "o_custkey": "o custkey",
    "o_orderstatus": "O_ORDERSTATUS",
    "o_totalprice": "oTotalPrice",
    "o_orderdate": "o_orderdate",
    "o_orderpriority": "O OrderPriority",
}
NOTE = "note"


def _faulty_orders(orders: DataFrame) -> DataFrame:
    """Order texts with planted faults: wrong type, blank, orphan, unknown status."""
    texts = csv_texts(orders)
    key = F.col("o_orderkey").cast("bigint")
    return texts.select(
        "o_orderkey",
        F.when(key % 89 == 0, "")
        .when(key % 79 == 0, (F.col("o_custkey").cast("bigint") + 1_000_000).cast("string"))
        .otherwise(F.col("o_custkey"))
        .alias("o_custkey"),
        F.when(key % 73 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 97 == 0, "oops").otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
        F.lit('said "no"').alias(NOTE),
    )


def _renamed(texts: DataFrame) -> DataFrame:
    return texts.select(*[F.col(c).alias(HEADERS.get(c, c)) for c in texts.columns])


def write_faulty_files(spark: SparkSession, folder: str) -> str:
    """CSV folders read in name order: orders with faults, clean second copies of
    some, and lines with a field too many. Returns a pattern that finds them."""
    orders = open_catalog(spark, folder).table("orders")
    out = storage.new_folder(spark, "faulty")
    write_csv(_renamed(_faulty_orders(orders)), f"{out}/1_all")
    copies = csv_texts(orders.where(F.col("o_orderkey") % 83 == 0)).withColumns(
        {"o_orderpriority": F.lit("COPY"), NOTE: F.lit("copy")}
    )
    write_csv(_renamed(copies), f"{out}/2_copies")
    ragged = csv_texts(orders.where(F.col("o_orderkey") % 71 == 0)).withColumn(NOTE, F.lit("ragged"))
    header = ",".join(f'"{HEADERS.get(c, c)}"' for c in ragged.columns)
    # One partition per file: its first line, number 0 there, goes below a header.
    lines = csv_lines(ragged).select(F.concat("line", F.lit(',"extra"')).alias("line"))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    with_header = lines.select(F.when(first, F.array(F.lit(header), "line")).otherwise(F.array("line")).alias("lines"))
    with_header.select(F.explode("lines").alias("value")).write.option("lineSep", "\n").text(f"{out}/3_ragged")
    return f"{out}/*"


def _target_orders(catalog: Catalog) -> DataFrame:
    return catalog.table("orders").where(F.col("o_orderkey") % 67 == 0)


def imported(spark: SparkSession, folder: str) -> ingest.Checked:
    """The faulty files, none of whose cells holds a line break, so they can be split."""
    catalog = open_catalog(spark, folder)
    return ingest.import_csv(
        spark,
        write_faulty_files(spark, folder),
        catalog.contract("orders"),
        parents=catalog.table,
        target=_target_orders(catalog),
        multi_line=False,
    )


IMPORT_SQL = f"""
faulty AS (
  SELECT o_orderkey, 1 AS place, o_orderdate, o_orderpriority, 'said "no"' AS note,
    CASE WHEN o_orderkey % 89 = 0 THEN '' WHEN o_orderkey % 79 = 0 THEN CAST(o_custkey + 1000000 AS VARCHAR)
         ELSE CAST(o_custkey AS VARCHAR) END AS o_custkey,
    CASE WHEN o_orderkey % 73 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 97 = 0 THEN 'oops' ELSE {sql_number("o_totalprice")} END AS o_totalprice
  FROM orders
  UNION ALL
  SELECT o_orderkey, 2, o_orderdate, 'COPY', 'copy', CAST(o_custkey AS VARCHAR), o_orderstatus,
    {sql_number("o_totalprice")} FROM orders WHERE o_orderkey % 83 = 0
  UNION ALL
  SELECT o_orderkey, 3, o_orderdate, o_orderpriority, 'ragged', CAST(o_custkey AS VARCHAR), o_orderstatus,
    {sql_number("o_totalprice")} FROM orders WHERE o_orderkey % 71 = 0
), judged AS (
  SELECT *, CASE
    WHEN place = 3 THEN 'Row has a wrong number of fields.'
    WHEN o_custkey = '' THEN 'Invalid bigint value in column o_custkey.'
    WHEN o_totalprice = 'oops' THEN 'Invalid double value in column o_totalprice.'
    WHEN o_orderstatus NOT IN ('F', 'O', 'P') THEN 'Value not allowed in column o_orderstatus.'
    WHEN TRY_CAST(o_custkey AS BIGINT) NOT IN (SELECT c_custkey FROM customer)
      THEN 'Column o_custkey refers to no row of customer.c_custkey.' END AS fault
  FROM faulty
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey, fault IS NULL ORDER BY place) AS turn FROM judged
), decided AS (
  SELECT *, coalesce(fault, CASE WHEN turn > 1 OR o_orderkey % 67 = 0 THEN 'Duplicate key (o_orderkey).' END)
    AS reason FROM placed
)
"""
GOOD_SQL = f"""WITH {IMPORT_SQL} SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_orderstatus,
  CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderdate, o_orderpriority FROM decided WHERE reason IS NULL"""
_REJECT_COLUMNS = {
    "o_orderkey": "CAST(o_orderkey AS VARCHAR)",
    "o_orderdate": sql_iso("o_orderdate"),
}
REJECTS_SQL = f"""WITH {IMPORT_SQL} SELECT {", ".join(
    f'{_REJECT_COLUMNS.get(c, c)} AS "{h}"' for c, h in {**HEADERS, NOTE: NOTE}.items()
)}, reason AS _error_reason FROM decided WHERE reason IS NOT NULL"""
METRICS_SQL = f"""WITH {IMPORT_SQL} SELECT count(*) FILTER (reason IS NULL) AS successful_rows,
  count(*) FILTER (reason IS NOT NULL) AS failed_rows FROM decided"""
REJECT_LINES_SQL = f"""SELECT concat_ws(',', {", ".join(
    f"""'"' || replace("{h}", '"', '""') || '"'""" for h in [*HEADERS.values(), NOTE, "_error_reason"]
)}) AS line FROM ({REJECTS_SQL})"""


def _import_duplicate_target(spark: SparkSession, folder: str) -> DataFrame:
    """Counts where the target holds every one of its keys three times."""
    catalog = open_catalog(spark, folder)
    target = _target_orders(catalog)
    thrice = target.unionByName(target).unionByName(target)
    checked = ingest.import_csv(
        spark, write_faulty_files(spark, folder), catalog.contract("orders"), parents=catalog.table, target=thrice,
        multi_line=False,
    )
    return checked.metrics


def _streamed(spark: SparkSession, folder: str) -> import_stream.ImportFolders:
    """The faulty files, taken two files at a time."""
    catalog = open_catalog(spark, folder)
    pattern = write_faulty_files(spark, folder)
    folders = import_stream.ImportFolders.under(storage.new_folder(spark, "stream"))
    import_stream.import_stream(
        spark,
        pattern,
        catalog.contract("orders"),
        folders,
        parents=catalog.table,
        target=_target_orders(catalog),
        files_per_batch=2,
        multi_line=False,
    ).awaitTermination()
    return folders


def _import_stream(spark: SparkSession, folder: str) -> DataFrame:
    return import_stream.imported(spark, _streamed(spark, folder).good).drop(import_stream.BATCH)


def _import_stream_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Running totals after the last batch."""
    steps = import_stream.progress(spark, _streamed(spark, folder))
    return steps.orderBy(F.desc("batch")).limit(1).select("successful_rows", "failed_rows")


# --------------------------------------------------------------------- writes


def _requests(orders: DataFrame) -> DataFrame:
    """Write requests as maps from column to text, some of them unsound."""
    key = F.col("o_orderkey")
    entries = {
        "o_orderkey": F.when(key % 17 != 0, key.cast("string")),
        "o_custkey": F.when(key % 13 == 0, " 0x1F ").otherwise(F.col("o_custkey").cast("string")),
        "o_totalprice": F.when(key % 11 == 0, "1d").when(key % 7 == 0, "  ").otherwise(F.lit("12.5")),
        "o_orderpriority": F.when(key % 5 == 0, F.col("o_orderpriority")),
        "shipped": F.when(key % 19 == 0, "yes"),
    }
    every = F.create_map(*[part for k, v in entries.items() for part in (F.lit(k), v)])
    given = F.map_filter(every, lambda _, v: v.isNotNull())
    nothing = F.create_map().cast("map<string,string>")
    return orders.select("o_orderkey", F.when(key % 23 == 0, nothing).otherwise(given).alias("values"))


def _shown_errors(validated: DataFrame) -> list[Column]:
    entries = F.array_sort(F.map_entries(mutate.FIELD_ERRORS))
    shown = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return [F.array_join(shown, ";").alias("field_errors"), F.col(mutate.ERROR)]


def _validate_insert(spark: SparkSession, folder: str) -> DataFrame:
    catalog = open_catalog(spark, folder)
    checked = mutate.validate_rows(
        _requests(catalog.table("orders")), catalog.contract("orders"), mutate.INSERT
    )
    return checked.select(
        F.col("o_orderkey").alias("request"),
        "new_o_orderkey",
        "new_o_custkey",
        "new_o_totalprice",
        "new_o_orderpriority",
        F.concat_ws(
            ",", *[F.when(F.col(f"has_{c}"), c) for c in catalog.contract("orders").columns]
        ).alias("provided"),
        *_shown_errors(checked),
    )


VALIDATE_INSERT_SQL = """
WITH asked AS (
  SELECT o_orderkey AS request, o_orderkey % 23 = 0 AS nothing,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_orderkey END AS k,
    CASE WHEN o_orderkey % 13 = 0 THEN 31 ELSE o_custkey END AS c,
    o_orderkey % 11 = 0 AS bad, o_orderkey % 7 = 0 AS blank,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS p, o_orderkey % 19 = 0 AS extra
  FROM orders
)
SELECT request, CASE WHEN NOT nothing THEN k END AS new_o_orderkey,
  CASE WHEN NOT nothing THEN CAST(c AS BIGINT) END AS new_o_custkey,
  CASE WHEN NOT nothing AND NOT bad AND NOT blank THEN CAST(12.5 AS DOUBLE) END AS new_o_totalprice,
  CASE WHEN NOT nothing THEN p END AS new_o_orderpriority,
  CASE WHEN nothing THEN '' ELSE concat_ws(',', CASE WHEN k IS NOT NULL THEN 'o_orderkey' END, 'o_custkey',
    CASE WHEN NOT bad THEN 'o_totalprice' END, CASE WHEN p IS NOT NULL THEN 'o_orderpriority' END) END AS provided,
  CASE WHEN nothing THEN '' ELSE concat_ws(';', CASE WHEN bad THEN 'o_totalprice=o_totalprice must be numeric.' END,
    CASE WHEN extra THEN 'shipped=Unknown column.' END) END AS field_errors,
  CASE WHEN nothing THEN 'No editable values were provided.'
       WHEN bad OR extra THEN 'Validation failed.' END AS error
FROM asked
"""


def _update_requests(orders: DataFrame) -> DataFrame:
    """Two rounds of updates: prices set or cleared, then priorities; some of keys
    that are missing, blank, unparseable or not in the table."""
    key = F.col("o_orderkey")
    identity = F.create_map(
        F.lit("o_orderkey"),
        F.when(key % 29 == 0, F.lit(None))
        .when(key % 31 == 0, "abc")
        .when(key % 37 == 0, " ")
        .when(key % 11 == 0, (-key - 1).cast("string"))
        .otherwise(key.cast("string")),
    )
    price = F.create_map(
        F.lit("o_totalprice"), F.when(key % 3 == 0, "").otherwise((key + F.lit(0.25)).cast("string"))
    )
    priority = F.create_map(
        F.lit("o_orderpriority"), F.concat(F.lit("P"), (key % 4).cast("string")), F.lit("o_totalprice"), F.lit("1e3")
    )
    edit = F.create_map(F.lit("o_orderkey"), F.lit("1"))
    first = orders.where(key % 2 == 0).select(
        key.alias("request"), F.lit(1).alias("round"), identity.alias("identity"),
        F.when(key % 41 == 0, edit).otherwise(price).alias("values"),
    )
    second = orders.where(key % 5 == 0).select(
        key.alias("request"), F.lit(2).alias("round"), identity.alias("identity"), priority.alias("values")
    )
    return first.unionByName(second)


def validated_updates(catalog: Catalog) -> tuple[DataFrame, Contract]:
    declared = catalog.contract("orders")
    requests = _update_requests(catalog.table("orders"))
    return mutate.validate_rows(requests, declared, mutate.UPDATE), declared


def _validate_update(spark: SparkSession, folder: str) -> DataFrame:
    checked, _ = validated_updates(open_catalog(spark, folder))
    return checked.select("request", "round", "key_o_orderkey", "new_o_totalprice", "new_o_orderpriority",
                          *_shown_errors(checked))


UPDATES_SQL = """
asked AS (
  SELECT o_orderkey AS request, 1 AS round, o_orderkey % 41 = 0 AS edit,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey + CAST(0.25 AS DOUBLE) END AS price,
    CAST(NULL AS VARCHAR) AS priority FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL
  SELECT o_orderkey, 2, false, CAST(1000 AS DOUBLE), 'P' || (o_orderkey % 4) FROM orders WHERE o_orderkey % 5 = 0
), judged AS (
  SELECT *, CASE WHEN request % 29 = 0 OR request % 31 = 0 OR request % 37 = 0 THEN NULL
      WHEN request % 11 = 0 THEN -request - 1 ELSE request END AS key,
    CASE WHEN request % 29 = 0 THEN 'Missing primary key value.'
      WHEN request % 31 = 0 THEN 'o_orderkey must be numeric.'
      WHEN request % 37 = 0 THEN 'Primary key value cannot be null.' END AS key_fault
  FROM asked
)
"""
VALIDATE_UPDATE_SQL = f"""
WITH {UPDATES_SQL}
SELECT request, round, key AS key_o_orderkey, CASE WHEN NOT edit THEN price END AS new_o_totalprice,
  priority AS new_o_orderpriority,
  CASE WHEN edit THEN 'o_orderkey=Primary key columns cannot be edited.'
       WHEN key_fault IS NOT NULL THEN 'o_orderkey=' || key_fault ELSE '' END AS field_errors,
  CASE WHEN edit THEN 'Validation failed.' WHEN key_fault IS NOT NULL THEN 'Invalid row identity.' END AS error
FROM judged
"""


def _apply_updates(spark: SparkSession, folder: str) -> DataFrame:
    catalog = open_catalog(spark, folder)
    checked, declared = validated_updates(catalog)
    patch = mutate.latest_patch(checked, declared, "round")
    return mutate.apply_updates(catalog.table("orders"), patch, declared)


APPLY_UPDATES_SQL = f"""
WITH {UPDATES_SQL}, sound AS (
  SELECT * FROM judged WHERE NOT edit AND key_fault IS NULL
), patch AS (
  SELECT key, max(priority) AS priority, max(CASE WHEN round = 2 THEN 1 ELSE 0 END) AS second,
    max(CASE WHEN round = 1 THEN price END) AS first_price
  FROM sound GROUP BY key
)
SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus,
  CASE WHEN p.key IS NULL THEN o.o_totalprice WHEN p.second = 1 THEN 1000 ELSE p.first_price END AS o_totalprice,
  o.o_orderdate, coalesce(p.priority, o.o_orderpriority) AS o_orderpriority
FROM orders o LEFT JOIN patch p ON p.key = o.o_orderkey
"""


def _unmatched_updates(spark: SparkSession, folder: str) -> DataFrame:
    catalog = open_catalog(spark, folder)
    checked, declared = validated_updates(catalog)
    patch = mutate.latest_patch(checked, declared, "round")
    return mutate.unmatched_updates(catalog.table("orders"), patch, declared)


UNMATCHED_SQL = f"""
WITH {UPDATES_SQL}
SELECT DISTINCT key AS o_orderkey, 'No row was updated. The target row may no longer exist.' AS error
FROM judged WHERE NOT edit AND key_fault IS NULL AND key NOT IN (SELECT o_orderkey FROM orders)
"""


def _append_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and the sound ones of some insert requests."""
    catalog = open_catalog(spark, folder)
    customer, declared = catalog.table("customer"), catalog.contract("customer")
    requests = customer.where(F.col("c_nationkey") < 5).select(
        F.create_map(
            F.lit("c_custkey"), (F.col("c_custkey") + 10_000_000).cast("string"),
            F.lit("c_name"), F.concat(F.lit("  "), F.col("c_name")),
            F.lit("c_nationkey"), F.when(F.col("c_custkey") % 2 == 0, "3.5").otherwise(F.lit("+3.0")),
        ).alias("values")
    )
    rows = mutate.insert_values(mutate.validate_rows(requests, declared), declared)
    return mutate.append_rows(customer, rows, declared)


def _append_rows_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer inserted three times: under its own key, and twice under a new one."""
    catalog = open_catalog(spark, folder)
    customer, declared = catalog.table("customer"), catalog.contract("customer")
    copies = [
        customer.withColumn("round", F.lit(round_)).withColumn("c_custkey", F.col("c_custkey") + shift)
        for round_, shift in ((1, 0), (2, 10_000_000), (3, 10_000_000))
    ]
    rows = reduce(DataFrame.unionByName, copies)
    rows = rows.withColumn("c_name", F.concat("c_name", F.lit(" "), F.col("round").cast("string")))
    return mutate.append_rows(customer, rows, declared, "round")


APPEND_DUPLICATES_SQL = """
SELECT * FROM customer
UNION ALL
SELECT c_custkey + 10000000, c_name || ' 2', c_nationkey, c_acctbal, c_mktsegment FROM customer
"""


APPEND_SQL = """
SELECT * FROM customer
UNION ALL
SELECT c_custkey + 10000000, '  ' || c_name, CAST(3 AS INTEGER), NULL, NULL FROM customer
WHERE c_nationkey < 5 AND c_custkey % 2 <> 0
"""


def _strict_parsing(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers and booleans read strictly from texts made of order values."""
    key = F.col("o_orderkey")
    forms = F.array(
        F.lit("1d"), F.lit("NaN"), F.lit("Infinity"), F.lit("0x10"), F.lit("t"), F.lit(" Yes "), F.lit("n"),
        F.lit("1"), F.lit(".5e1"), F.lit("5."), F.lit("+7"), F.lit("--7"), F.lit(""), key.cast("string"),
        F.concat(key.cast("string"), F.lit("e2")), F.col("o_orderstatus"), F.lit("1e999"),
    )
    texts = open_catalog(spark, folder).table("orders").select(key, F.explode(forms).alias("text"))
    bodies = texts.withColumn("body", parsing.trimmed(F.col("text")))
    return bodies.select(
        "o_orderkey",
        "text",
        parsing.parse_number(F.col("body")).alias("number"),
        parsing.parse_boolean(F.col("body")).alias("flag"),
    )


STRICT_SQL = """
SELECT o_orderkey, text,
  CASE WHEN text = '0x10' THEN 16.0
       WHEN regexp_full_match(text, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') AND text <> '1e999'
       THEN CAST(text AS DOUBLE) END AS number,
  CASE WHEN lower(trim(text)) IN ('true', '1', 'yes', 'y') THEN true
       WHEN lower(trim(text)) IN ('false', '0', 'no', 'n') THEN false END AS flag
FROM (SELECT o_orderkey, unnest(['1d', 'NaN', 'Infinity', '0x10', 't', ' Yes ', 'n', '1', '.5e1', '5.', '+7', '--7',
  '', CAST(o_orderkey AS VARCHAR), o_orderkey || 'e2', o_orderstatus, '1e999']) AS text FROM orders)
"""


# ----------------------------------------------------------------- generation

SEED = 7


def _ids_of(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias(generate.ROW_ID))


def _seed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A synthetic order for every order, its customer from all customers."""
    catalog = open_catalog(spark, folder)
    ids = _ids_of(catalog.table("orders"), "o_orderkey")
    rows = generate.seed_rows(ids, catalog.contract("orders"), SEED, catalog.table)
    return rows.withColumnRenamed(generate.ROW_ID, "row_id")


def _seed_rows_whole_pool(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the pool asked for by name."""
    catalog = open_catalog(spark, folder)
    ids = _ids_of(catalog.table("orders"), "o_orderkey")
    rows = generate.seed_rows(ids, catalog.contract("orders"), SEED, catalog.table, pool_limit=None)
    return rows.select(F.col(generate.ROW_ID).alias("row_id"), "o_custkey")


def _seed_hash(column: str, table: str = "orders", row_id: str = "o_orderkey") -> str:
    return sql_hash((str(SEED), table, column), f"CAST({row_id} AS VARCHAR)")


def _seconds(h: str, span: int) -> str:
    return f"to_seconds({sql_hex(h, 1)} % {span})"


def _pooled(h: str, limit: int | None) -> str:
    cut = "" if limit is None else f"LIMIT {limit}"
    pool = f"SELECT c_custkey FROM customer ORDER BY c_custkey {cut}"
    return f"""pool AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS slot FROM ({pool})),
keyed AS (SELECT o_orderkey AS row_id, {h} AS h FROM orders),
drawn AS (SELECT row_id, c_custkey AS o_custkey FROM keyed, pool
  WHERE slot = {sql_hex("h", 1, 15)} % (SELECT count(*) FROM pool))"""


SEED_SQL = f"""
WITH {_pooled(_seed_hash("o_custkey"), None)}
SELECT o_orderkey AS row_id, {sql_hex(_seed_hash("o_orderkey"), 1, 15)} % 1001 AS o_orderkey, d.o_custkey,
  {sql_pick(("F", "O", "P"), _seed_hash("o_orderstatus"), 1)} AS o_orderstatus,
  CAST({sql_hex(_seed_hash("o_totalprice"), 1, 15)} % 1001 AS DOUBLE) AS o_totalprice,
  TIMESTAMP '2026-01-01 00:00:00' + {_seconds(_seed_hash("o_orderdate"), fakes.RECENT_SECONDS)} AS o_orderdate,
  {sql_pick(fakes.WORDS, _seed_hash("o_orderpriority"), 1)} AS o_orderpriority
FROM orders o JOIN drawn d ON d.row_id = o.o_orderkey
"""
SEED_WHOLE_SQL = f"WITH {_pooled(_seed_hash('o_custkey'), None)} SELECT row_id, o_custkey FROM drawn"


SEED_FIELDS = {
    "user_id": (T.IntegerType(), "user_id", "key"),
    "first_name": (T.StringType(), "first_name", "first"),
    "last_name": (T.StringType(), "last_name", "last"),
    "email": (T.StringType(), "email", "email"),
    "shop_name": (T.StringType(), "shop_name", "company"),
    "city": (T.StringType(), "city", "city"),
    "country": (T.StringType(), "country", "country"),
    "zip": (T.StringType(), "zip", "zip"),
    "street": (T.StringType(), "street", "address"),
    "phone": (T.StringType(), "phone", "phone"),
    "website": (T.StringType(), "website", "url"),
    "company": (T.StringType(), "company", "company"),
    "bio": (T.StringType(), "bio", "two"),
    "code_id": (T.StringType(), "code_id", "word"),
    "visits": (T.LongType(), "visits", "count"),
    "active": (T.BooleanType(), "active", "flag"),
    "seen": (T.TimestampNTZType(), "seen", "recent"),
    "ratio": (T.DoubleType(), "ratio", "fraction"),
}


def _seed_rules(spark: SparkSession, folder: str) -> DataFrame:
    """One row per customer with a column for every rule on names and types."""
    schema = T.StructType([T.StructField(name, kind) for name, (kind, _, _) in SEED_FIELDS.items()])
    ids = _ids_of(open_catalog(spark, folder).table("customer"), "c_custkey")
    rows = generate.seed_rows(ids, Contract("people", schema), SEED)
    return rows.withColumnRenamed(generate.ROW_ID, "row_id")


def _seed_rules_sql() -> str:
    columns = []
    for name, (_, column, rule) in SEED_FIELDS.items():
        h = _seed_hash(column, "people", "c_custkey")
        more = {
            "key": f"CAST(1 + {sql_hex(h, 1, 15)} % 100 AS INTEGER)",
            "zip": f"lpad(CAST({sql_hex(h, 1)} % 100000 AS VARCHAR), 5, '0')",
            "url": f"'https://' || {sql_pick(fakes.WORDS, h, 1)} || '-' || substr({h}, 25, 8) || '.example.com/'",
            "word": sql_pick(fakes.WORDS, h, 1),
            "count": f"{sql_hex(h, 1, 15)} % 1001",
            "flag": f"{sql_hex(h, 1)} % 2 = 1",
            "recent": f"TIMESTAMP '2026-01-01 00:00:00' + {_seconds(h, fakes.RECENT_SECONDS)}",
            "fraction": f"CAST({sql_hex(h, 1, 15)} % 1001 AS DOUBLE)",
            "two": " || ' ' || ".join(sentence_sql(f"md5({h} || '{part}')", 8) for part in "ab"),
        }
        columns.append(f"{more.get(rule) or fake_sql(h)[rule]} AS {name}")
    return "SELECT c_custkey AS row_id, " + ",\n  ".join(columns) + " FROM customer"


QUERIES = [
    Query("import_good", lambda spark, folder: imported(spark, folder).good, GOOD_SQL),
    Query("import_rejects", lambda spark, folder: imported(spark, folder).rejects, REJECTS_SQL),
    Query("import_metrics", lambda spark, folder: imported(spark, folder).metrics, METRICS_SQL),
    Query("import_duplicate_target", _import_duplicate_target, METRICS_SQL),
    Query("reject_csv_lines",
          lambda spark, folder: ingest.reject_lines(imported(spark, folder).rejects), REJECT_LINES_SQL),
    Query("import_stream", _import_stream, GOOD_SQL),
    Query("import_stream_progress", _import_stream_progress, METRICS_SQL),
    Query("validate_insert", _validate_insert, VALIDATE_INSERT_SQL),
    Query("validate_update", _validate_update, VALIDATE_UPDATE_SQL),
    Query("apply_updates", _apply_updates, APPLY_UPDATES_SQL),
    Query("unmatched_updates", _unmatched_updates, UNMATCHED_SQL),
    Query("append_rows", _append_rows, APPEND_SQL),
    Query("append_rows_duplicates", _append_rows_duplicates, APPEND_DUPLICATES_SQL),
    Query("strict_parsing", _strict_parsing, STRICT_SQL),
    Query("seed_rows", _seed_rows, SEED_SQL),
    Query("seed_rows_whole_pool", _seed_rows_whole_pool, SEED_WHOLE_SQL),
    Query("seed_name_rules", _seed_rules, _seed_rules_sql()),
]
