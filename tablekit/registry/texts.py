"""Registered queries: CSV, COPY and INSERT text, cells, anonymization, manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekit.functions import fakes, rendering
from tablekit.operators import dump
from tablekit.operators.anonymize import Rule, anonymize
from tablekit.registry.base import (
    PRIMARY_KEYS,
    TABLES,
    Query,
    open_catalog,
    sql_hash,
    sql_hex,
    sql_iso,
    sql_number,
    sql_pick,
)
from tablekit.sources import storage
from tablekit.sources.copy_text import read_copy_text
from tablekit.sources.csv_files import (
    CORRUPT,
    csv_lines,
    read_csv_text,
    sniff_csv,
    write_csv,
    write_database,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return open_catalog(spark, folder).table(name)


# ---------------------------------------------------------------------- CSV


def _csv_of(name: str, *keep: str):
    return lambda spark, folder: csv_lines(_table(spark, folder, name), *keep)


def _sql_csv(texts: list[str]) -> str:
    return " || ',' || ".join(
        f"'\"' || replace(coalesce({t}, ''), '\"', '\"\"') || '\"'" for t in texts
    )


DOCUMENT_TEXTS = ["CAST(doc_id AS VARCHAR)", "text", "lang", "source", "CAST(n_chars AS VARCHAR)"]
LINEITEM_TEXTS = [
    *[f"CAST({c} AS VARCHAR)" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
    *[sql_number(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
    "l_returnflag", "l_linestatus", sql_iso("l_shipdate"),
]


def _csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as CSV files and read back as text."""
    out = storage.new_folder(spark, "csv")
    write_csv(_table(spark, folder, "documents"), out)
    return read_csv_text(spark, out).select("doc_id", "text", "lang", "source", "n_chars")


def _csv_database(spark: SparkSession, folder: str) -> DataFrame:
    """Every table written as CSV; the records found in each folder."""
    out = storage.new_folder(spark, "database")
    folders = write_database(open_catalog(spark, folder), out)
    read = {name: read_csv_text(spark, f"{out}/{part}") for name, part in folders.items()}
    counts = [
        df.agg(F.count(df.columns[0]).alias("row_count"), F.count(CORRUPT).alias("ragged")).select(
            F.lit(name).alias("table_name"), F.lit(folders[name]).alias("folder"), "row_count", "ragged"
        )
        for name, df in read.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def _csv_semicolon(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written with semicolons; the delimiter is found on reading."""
    out = storage.new_folder(spark, "csv")
    write_csv(_table(spark, folder, "customer"), out, ";")
    layout = sniff_csv(spark, out)
    read = read_csv_text(spark, out, layout).select(*layout.headers)
    return read.withColumn("delimiter", F.lit(layout.delimiter))


def _csv_stray_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Parts written with quotes inside bare cells; blocks are read side by side."""
    out = storage.new_folder(spark, "csv")
    part = _table(spark, folder, "part")
    cells = part.select("p_partkey", F.concat(F.lit('5" '), "p_brand", F.lit(' "x')).alias("label"))
    cells.write.option("quote", "\u0000").csv(out, header=True)
    return read_csv_text(spark, out, multi_line=False).select("p_partkey", "label")


def _copy_header_like_row(spark: SparkSession, folder: str) -> DataFrame:
    """A data row that reads like the header of its file comes back as data."""
    out = storage.new_folder(spark, "copy")
    part = _table(spark, folder, "part").select(F.col("p_brand").alias("label"))
    header = dump.copy_header("part", ["label"])
    dump.copy_lines(part).write.text(f"{out}/rows")
    framed = spark.range(1).select(F.lit(f"{header}\n{header}").alias("lines"))
    framed.write.text(f"{out}/framed")
    return read_copy_text(spark, f"{out}/*", "part", part.schema)


# --------------------------------------------------------------------- COPY


def _copy_of(name: str, *keep: str):
    return lambda spark, folder: dump.copy_lines(_table(spark, folder, name), *keep)


def _sql_copy(texts: list[str]) -> str:
    def cell(text: str) -> str:
        escaped = f"replace({text}, '\\', '\\\\')"
        for code, mark in ((9, "\\t"), (10, "\\n"), (13, "\\r")):
            escaped = f"replace({escaped}, chr({code}), '{mark}')"
        return f"coalesce({escaped}, '\\N')"

    return " || chr(9) || ".join(cell(t) for t in texts)


def _with_null_text(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with backslashes and carriage returns added, and some without a URL."""
    pages = _table(spark, folder, "pages")
    return pages.select(
        "page_id",
        F.when(F.col("page_id") % 3 != 0, F.col("url")).alias("url"),
        F.concat(F.lit("\\N\t\\"), F.col("html"), F.lit("\r\n\\t\\\\n")).alias("html"),
    )


NULL_TEXT_SQL = r"""(SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN url END AS url,
  '\N' || chr(9) || '\' || html || chr(13) || chr(10) || '\t\\n' AS html FROM pages)"""


def _copy_escapes_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    pages = _with_null_text(spark, folder)
    return dump.copy_rows(dump.copy_lines(pages), pages.schema)


def _copy_round_trip(name: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = _table(spark, folder, name)
        out = storage.new_folder(spark, "copy")
        dump.copy_lines(df).write.text(out)
        return read_copy_text(spark, out, name, df.schema)

    return run


# ------------------------------------------------------------------- INSERT


def _inserts_of(name: str, dialect: str):
    return lambda spark, folder: dump.insert_statements(
        _table(spark, folder, name), name, dialect, PRIMARY_KEYS.get(name, ())
    )


def _sql_inserts(table: str, head: str, literals: list[str], order: str) -> str:
    row = "'(' || " + " || ', ' || ".join(literals) + " || ')'"
    return f"""
WITH numbered AS (
  SELECT CAST((row_number() OVER (ORDER BY {order}) - 1) // 1000 AS BIGINT) AS batch,
    row_number() OVER (ORDER BY {order}) AS place, {row} AS vals
  FROM {table}
)
SELECT batch, '{head} VALUES ' || string_agg(vals, ', ' ORDER BY place) || ';' AS statement
FROM numbered GROUP BY batch
"""


def _sql_text_literal(text: str) -> str:
    return f"coalesce('''' || replace({text}, '''', '''''') || '''', 'NULL')"


def _literal_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Literals of numbers that are not finite, flags, instants, lists and quotes."""
    events = _table(spark, folder, "events")
    odd = events.select(
        "event_id",
        F.when(F.col("event_id") % 5 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 5 == 1, F.lit(float("inf")))
        .when(F.col("event_id") % 5 != 2, F.col("value"))
        .alias("value"),
        (F.col("event_type") == "click").alias("is_click"),
        "ts",
        F.concat(F.lit("it's "), F.col("props")).alias("props"),
        F.array(F.col("user_id"), F.col("event_id")).alias("pair"),
    )
    types = {f.name: f.dataType for f in odd.schema.fields}
    return odd.select(
        "event_id",
        *[
            rendering.sql_literal(F.col(c), types[c], dialect).alias(f"{c}_{dialect}")
            for c in ("value", "is_click", "ts", "props", "pair")
            for dialect in (rendering.SQLITE, rendering.MYSQL)
        ],
    )


def _literal_flags_sql() -> str:
    number = sql_number("value")
    pieces = {
        "value": f"CASE WHEN event_id % 5 IN (0, 1, 2) THEN 'NULL' ELSE {number} END",
        "ts": f"'''' || {sql_iso('ts')} || ''''",
        "props": "'''it''''s ' || replace(props, '''', '''''') || ''''",
        "pair": "'''[' || user_id || ',' || event_id || ']'''",
    }
    both = [f"{sql} AS {c}_{d}" for c, sql in pieces.items() for d in ("sqlite", "mysql")]
    flags = [
        "CASE WHEN event_type = 'click' THEN 'TRUE' ELSE 'FALSE' END AS is_click_sqlite",
        "CASE WHEN event_type = 'click' THEN '1' ELSE '0' END AS is_click_mysql",
    ]
    return f"SELECT event_id, {', '.join(both + flags)} FROM events"


# -------------------------------------------------------------------- cells


def _format_cells(spark: SparkSession, folder: str) -> DataFrame:
    events = _table(spark, folder, "events").withColumn(
        "value", F.when(F.col("event_id") % 4 != 0, F.col("value"))
    )
    types = {f.name: f.dataType for f in events.schema.fields}
    return events.select(
        *[rendering.display_cell(F.col(c), types[c]).alias(c) for c in events.columns]
    )


def _format_cells_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as JSON, their numbers rounded to what both engines print alike."""
    vectors = _table(spark, folder, "embeddings").select(
        "vec_id", F.transform("embedding", lambda v: F.round(v.cast("double"), 4)).alias("embedding")
    )
    field = vectors.schema["embedding"].dataType
    return vectors.select("vec_id", rendering.display_cell(F.col("embedding"), field).alias("embedding"))


# ------------------------------------------------------------ anonymization

SEED = 7


def _anonymized(name: str, rules: list[Rule], *keep: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = _table(spark, folder, name)
        for extra in keep:
            df = df.withColumn(f"source_{extra}", F.col(extra))
        return anonymize(df, name, rules, SEED)

    return run


MASK_RULES = [
    Rule("customer", "c_name", "mask", preserve_start=4, preserve_end=3),
    Rule("customer", "c_mktsegment", "mask", mask_char="#", preserve_start=5, preserve_end=4),
    Rule("customer", "c_acctbal", "mask", preserve_end=2),
    Rule("customer", "no_such_column", "mask"),
    Rule("orders", "c_nationkey", "redact"),
]
_BALANCE = sql_number("c_acctbal")
MASK_SQL = f"""
SELECT c_custkey, left(c_name, 4) || repeat('*', length(c_name) - 7) || right(c_name, 3) AS c_name, c_nationkey,
  CASE WHEN length({_BALANCE}) <= 2 THEN repeat('*', length({_BALANCE}))
       ELSE repeat('*', length({_BALANCE}) - 2) || right({_BALANCE}, 2) END AS c_acctbal,
  CASE WHEN length(c_mktsegment) <= 9 THEN repeat('#', length(c_mktsegment))
       ELSE left(c_mktsegment, 5) || repeat('#', length(c_mktsegment) - 9) || right(c_mktsegment, 4) END
    AS c_mktsegment
FROM customer
"""


def _redacted(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations").withColumn(
        "text", F.when(F.col("turn") > 0, F.col("text"))
    )
    rules = [Rule("conversations", "text", "redact"), Rule("conversations", "role", "null")]
    return anonymize(turns, "conversations", rules, SEED)


FAKE_METHODS = {
    "name": "faker:name", "first": "faker:firstName", "last": "faker:lastName", "email": "faker:email",
    "phone": "faker:phone", "address": "faker:address", "city": "faker:city", "country": "faker:country",
    "company": "faker:company", "uuid": "faker:uuid", "number": "faker:number", "text": "faker:text",
}
FAKE_OPTIONS = {"number": {"low": 100, "high": 200}, "text": {"max_length": 40}}


def _fakes(spark: SparkSession, folder: str) -> DataFrame:
    """One fake of every kind per customer, keyed by name; some names are missing."""
    named = _table(spark, folder, "customer").select(
        "c_custkey",
        *[
            F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")).alias(column)
            for column in FAKE_METHODS
        ],
    )
    rules = [
        Rule("customer", column, method, scope="person", **FAKE_OPTIONS.get(column, {}))
        for column, method in FAKE_METHODS.items()
    ]
    return anonymize(named, "customer", rules, SEED)


def sentence_sql(h: str, span: int) -> str:
    """SQL of a sentence of three to ``span`` + 2 words."""
    word = sql_pick(fakes.WORDS, f"md5({h} || i)", 1)
    words = f"list_transform(range(1, {sql_hex(h, 1)} % {span} + 4), lambda i: {word})"
    text = f"array_to_string({words}, ' ')"
    return f"upper(left({text}, 1)) || substr({text}, 2) || '.'"


def fake_sql(h: str) -> dict[str, str]:
    """SQL of every fake, from the text of the hash."""
    first, last = sql_pick(fakes.FIRST_NAMES, h, 1), sql_pick(fakes.LAST_NAMES, h, 9)

    def digits(start: int, width: int) -> str:
        return f"lpad(CAST({sql_hex(h, start)} % {10**width} AS VARCHAR), {width}, '0')"

    return {
        "name": f"{first} || ' ' || {last}",
        "first": first,
        "last": last,
        "email": f"lower({first} || '.' || {last} || '.' || substr({h}, 25, 8)) || '@example.com'",
        "phone": f"'+1-555-' || {digits(1, 3)} || '-' || {digits(9, 4)} || '-' || {digits(17, 4)}",
        "address": f"({sql_hex(h, 1)} % 999 + 1) || ' ' || {sql_pick(fakes.STREETS, h, 9)}",
        "city": sql_pick(fakes.CITIES, h, 1),
        "country": sql_pick(fakes.COUNTRIES, h, 1),
        "company": f"{sql_pick(fakes.COMPANIES, h, 1)} || ' ' || {sql_pick(fakes.COMPANY_FORMS, h, 9)}"
        f" || ' ' || substr({h}, 25, 8)",
        "uuid": f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-' || "
        f"substr('89ab', CAST({sql_hex(h, 17, 1)} % 4 + 1 AS INTEGER), 1) || substr({h}, 18, 3) || '-' || "
        f"substr({h}, 21, 12)",
        "number": f"100 + {sql_hex(h, 1, 15)} % 101",
        "text": f"left({sentence_sql(h, 5)}, 40)",
    }


def _fakes_sql() -> str:
    h = sql_hash((str(SEED), "person"), "c_name")
    columns = ",\n  ".join(
        f"CASE WHEN c_custkey % 10 <> 0 THEN {sql} END AS {name}" for name, sql in fake_sql("h").items()
    )
    return f"SELECT c_custkey,\n  {columns}\nFROM (SELECT *, {h} AS h FROM customer)"


CHAIN_RULES = [
    Rule("supplier", "s_name", "faker:city"),
    Rule("supplier", "s_acctbal", "faker:number"),
    Rule("supplier", "s_name", "mask", preserve_start=2),
]
_CHAIN_CITY = sql_pick(fakes.CITIES, "h", 1)
CHAIN_SQL = f"""
SELECT s_suppkey, left(city, 2) || repeat('*', length(city) - 2) AS s_name, s_nationkey,
  {sql_hex("b", 1, 15)} % 1000001 AS s_acctbal, s_name AS source_s_name
FROM (SELECT *, {_CHAIN_CITY} AS city FROM (
  SELECT *, {sql_hash((str(SEED), "supplier", "s_name"), "s_name")} AS h,
    {sql_hash((str(SEED), "supplier", "s_acctbal"), sql_number("s_acctbal"))} AS b FROM supplier))
"""


DUMP_RULES = [
    Rule("conversations", "text", "mask", preserve_start=1),
    Rule("conversations", "role", "faker:country"),
    Rule("customer", "c_name", "faker:name"),
]


def _dump_lines(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations")
    return dump.render(anonymize(turns, "conversations", DUMP_RULES, SEED), "conversations", rendering.POSTGRES)


_MASKED = "left(text, 1) || repeat('*', length(text) - 1)"
DUMP_SQL = f"""
SELECT {_sql_copy([
    "CAST(conv_id AS VARCHAR)",
    "CAST(turn AS VARCHAR)",
    sql_pick(fakes.COUNTRIES, "h", 1),
    f"CASE WHEN length(text) <= 1 THEN repeat('*', length(text)) ELSE {_MASKED} END",
])} AS line
FROM (SELECT *, {sql_hash((str(SEED), "conversations", "role"), "role")} AS h FROM conversations)
"""

MANIFEST_TABLES = ["conversations", "customer", "orders", "lineitem"]


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return dump.manifest(open_catalog(spark, folder), DUMP_RULES, SEED, MANIFEST_TABLES)


MANIFEST_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{name}' AS table_name, count(*) AS row_count, CAST({sum(r.table == name for r in DUMP_RULES)} AS BIGINT)
  AS rule_count, '{SEED}' AS seed, count(*) = 0 AS is_empty FROM {name}"""
    for name in MANIFEST_TABLES[:4]
)


def _full_dump(spark: SparkSession, folder: str) -> DataFrame:
    """Whole dump of two tables written to files, and all its text lines read back."""
    out = storage.new_folder(spark, "dump")
    dump.anonymized_dump(
        open_catalog(spark, folder), DUMP_RULES, out, rendering.POSTGRES, SEED, ["conversations", "customer"]
    )
    parts = ("1_header", "2_data", "3_footer")
    read = [
        spark.read.text(f"{out}/{name}/{part}", lineSep="\n").select(
            F.lit(name).alias("table_name"), F.lit(part).alias("part"), F.col("value").alias("line")
        )
        for name in ("conversations", "customer")
        for part in parts
    ]
    return reduce(DataFrame.unionByName, read)


_CUSTOMER_COPY = _sql_copy([
    "CAST(c_custkey AS VARCHAR)",
    fake_sql("h")["name"],
    "CAST(c_nationkey AS VARCHAR)",
    sql_number("c_acctbal"),
    "c_mktsegment",
])
FULL_DUMP_SQL = f"""
SELECT 'conversations' AS table_name, '2_data' AS part, line FROM ({DUMP_SQL})
UNION ALL SELECT 'customer', '2_data', {_CUSTOMER_COPY}
FROM (SELECT *, {sql_hash((str(SEED), "customer", "c_name"), "c_name")} AS h FROM customer)
UNION ALL SELECT 'conversations', '1_header',
  'COPY "conversations" ("conv_id", "turn", "role", "text") FROM stdin;'
UNION ALL SELECT 'customer', '1_header',
  'COPY "customer" ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment") FROM stdin;'
UNION ALL SELECT 'conversations', '3_footer', '\\.' UNION ALL SELECT 'customer', '3_footer', '\\.'
"""


QUERIES = [
    Query("csv_lines", _csv_of("documents", "doc_id"),
          f"SELECT doc_id, {_sql_csv(DOCUMENT_TEXTS)} AS line FROM documents"),
    Query("csv_lines_numbers", _csv_of("lineitem"), f"SELECT {_sql_csv(LINEITEM_TEXTS)} AS line FROM lineitem"),
    Query("csv_round_trip", _csv_round_trip,
          """SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars
  FROM documents"""),
    Query("csv_database_export", _csv_database, "\nUNION ALL\n".join(
        f"""SELECT '{name}' AS table_name, '{name}.csv' AS folder, count(*) AS row_count,
  CAST(0 AS BIGINT) AS ragged FROM {name}""" for name in TABLES)),
    Query("csv_semicolon_source", _csv_semicolon,
          f"""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
  {sql_number("c_acctbal")} AS c_acctbal, c_mktsegment, ';' AS delimiter FROM customer"""),
    Query("csv_stray_quote_source", _csv_stray_quotes,
          """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, '5" ' || p_brand || ' "x' AS label FROM part"""),
    Query("copy_header_like_row", _copy_header_like_row,
          """SELECT p_brand AS label FROM part
  UNION ALL SELECT 'COPY "part" ("label") FROM stdin;'"""),
    Query("copy_lines", _copy_of("documents", "doc_id"),
          f"SELECT doc_id, {_sql_copy(DOCUMENT_TEXTS)} AS line FROM documents"),
    Query("copy_lines_numbers", _copy_of("lineitem"), f"SELECT {_sql_copy(LINEITEM_TEXTS)} AS line FROM lineitem"),
    Query("copy_escapes_round_trip", _copy_escapes_round_trip, f"SELECT * FROM {NULL_TEXT_SQL}"),
    Query("copy_round_trip", _copy_round_trip("orders"), "SELECT * FROM orders"),
    Query("copy_round_trip_documents", _copy_round_trip("documents"), "SELECT * FROM documents"),
    Query("copy_round_trip_embeddings", _copy_round_trip("embeddings"), "SELECT * FROM embeddings"),
    Query(
        "insert_statements",
        _inserts_of("customer", rendering.MYSQL),
        _sql_inserts(
            "customer",
            "INSERT INTO `customer` (`c_custkey`, `c_name`, `c_nationkey`, `c_acctbal`, `c_mktsegment`)",
            ["c_custkey", _sql_text_literal("c_name"), "c_nationkey", sql_number("c_acctbal"),
             _sql_text_literal("c_mktsegment")],
            "c_custkey",
        ),
    ),
    Query(
        "insert_statements_supplier",
        _inserts_of("supplier", rendering.SQLITE),
        _sql_inserts(
            "supplier",
            'INSERT INTO "supplier" ("s_suppkey", "s_name", "s_nationkey", "s_acctbal")',
            ["s_suppkey", _sql_text_literal("s_name"), "s_nationkey", sql_number("s_acctbal")],
            "s_suppkey",
        ),
    ),
    Query(
        "insert_statements_without_key",
        _inserts_of("lineitem", rendering.SQLITE),
        _sql_inserts(
            "lineitem",
            'INSERT INTO "lineitem" ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", '
            '"l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")',
            [*LINEITEM_TEXTS[:8], *[_sql_text_literal(t) for t in LINEITEM_TEXTS[8:]]],
            ", ".join(f"{c} ASC NULLS FIRST" for c in (
                "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")),
        ),
    ),
    Query("sql_literals", _literal_flags, _literal_flags_sql()),
    Query("format_cells", _format_cells,
          f"""SELECT CAST(event_id AS VARCHAR) AS event_id, {sql_iso("ts")} AS ts, CAST(user_id AS VARCHAR) AS user_id,
  event_type, CASE WHEN event_id % 4 <> 0 THEN {sql_number("value")} ELSE 'NULL' END AS value, props FROM events"""),
    Query("format_cells_embeddings", _format_cells_embeddings,
          """SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda v:
    CASE WHEN round(v::DOUBLE, 4) = 0 THEN '0'
      ELSE regexp_replace(printf('%.4f', round(v::DOUBLE, 4)), '\\.?0+$', '') END), ',') || ']' AS embedding
  FROM embeddings"""),
    Query("anon_mask", _anonymized("customer", MASK_RULES), MASK_SQL),
    Query("anon_redact_null", _redacted,
          """SELECT conv_id, turn, CAST(NULL AS VARCHAR) AS role,
  CASE WHEN turn > 0 THEN '[REDACTED]' END AS text FROM conversations"""),
    Query("anon_fakes", _fakes, _fakes_sql()),
    Query("anon_rule_chain", _anonymized("supplier", CHAIN_RULES, "s_name"), CHAIN_SQL),
    Query("anon_dump_lines", _dump_lines, DUMP_SQL),
    Query("anon_dump_files", _full_dump, FULL_DUMP_SQL),
    Query("dump_manifest", _manifest, MANIFEST_SQL),
]
