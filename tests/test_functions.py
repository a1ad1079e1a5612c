from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import fakes, kinds, parsing, rendering
from tablekit.operators.anonymize import mask

KIND_NAMES = {
    "interval": "numeric",
    "point": "numeric",
    "tinyint(1)": "numeric",
    "bigserial": "numeric",
    "timestamp": "temporal",
    "datetime": "temporal",
    "bool": "boolean",
    "BIT": "boolean",
    "varchar": "categorical",
    "array<int>": "numeric",
    "  ": "unknown",
}


def test_kinds_by_type_name(spark):
    df = spark.createDataFrame([(k,) for k in KIND_NAMES], "name string")
    rows = df.select("name", kinds.kind_from_type_name(F.col("name")).alias("kind")).collect()
    assert {r["name"]: r["kind"] for r in rows} == KIND_NAMES


@pytest.mark.parametrize(
    ("data_type", "kind"),
    [
        (T.LongType(), "numeric"),
        (T.DecimalType(10, 2), "numeric"),
        (T.DateType(), "temporal"),
        (T.TimestampNTZType(), "temporal"),
        (T.BooleanType(), "boolean"),
        (T.StringType(), "categorical"),
        (T.ArrayType(T.IntegerType()), "categorical"),
        (T.NullType(), "unknown"),
    ],
)
def test_kinds_by_type(data_type, kind):
    assert kinds.kind_of(data_type) == kind


NUMBERS = {
    "12": 12.0, " 7 ": 7.0, "+5": 5.0, "-5.25": -5.25, ".5": 0.5, "5.": 5.0, "1e3": 1000.0,
    "0x1F": 31.0, "0b101": 5.0, "0o17": 15.0, "\t8\n": 8.0,
    "1d": None, "1f": None, "NaN": None, "Infinity": None, "1e999": None, "": None, "abc": None, "1_000": None,
    "--1": None, "1 2": None, "0xZ": None, "0x": None,
}


def test_strict_numbers(spark):
    df = spark.createDataFrame([(k,) for k in NUMBERS], "text string")
    bodies = df.withColumn("body", parsing.trimmed(F.col("text")))
    rows = bodies.select("text", parsing.parse_number(F.col("body")).alias("n")).collect()
    assert {r["text"]: r["n"] for r in rows} == NUMBERS
    for text, number in NUMBERS.items():
        if text:
            assert parsing.number_from_text(text) == number


def test_booleans_of_writes_and_filters(spark):
    words = {"true": True, "YES": True, " y ": True, "1": True, "No": False, "n": False, "0": False,
             "t": None, "f": None, "": None, "2": None}
    df = spark.createDataFrame([(k,) for k in words], "text string")
    rows = df.select("text", parsing.parse_boolean(parsing.trimmed(F.col("text"))).alias("b")).collect()
    assert {r["text"]: r["b"] for r in rows} == words
    assert parsing.boolean_from_text("Yes") is True
    assert parsing.boolean_from_text("y") is None
    assert parsing.boolean_from_text(" true") is None


def test_typed_values(spark):
    cases = [
        ("9223372036854775807", T.LongType(), 9223372036854775807),
        ("9223372036854775808", T.LongType(), None),
        ("7.0", T.IntegerType(), 7),
        ("7.5", T.IntegerType(), None),
        ("300", T.ByteType(), None),
        ("1e2", T.ShortType(), 100),
        ("1e40", T.LongType(), None),
        ("2024-02-30", T.DateType(), None),
        ("2024-02-29", T.DateType(), dt.date(2024, 2, 29)),
        ("2024-02-29T01:02:03.004Z", T.StringType(), "2024-02-29T01:02:03.004Z"),
    ]
    for text, data_type, expected in cases:
        df = spark.createDataFrame([(text,)], "body string")
        assert df.select(parsing.typed_value(F.col("body"), data_type)).first()[0] == expected, text


NUMBER_TEXTS = {
    123.0: "123", 12345678.9: "12345678.9", -0.0: "0", 0.1: "0.1", 1e7: "10000000", 1e21: "1e+21",
    123456789012345680000.0: "123456789012345680000", 1.5e300: "1.5e+300", 1e-6: "0.000001", 1.5e-7: "1.5e-7",
    1e-7: "1e-7", -2.5: "-2.5", 0.002: "0.002", 0.00012345: "0.00012345", -1234567890.125: "-1234567890.125",
    99999999.99: "99999999.99", 1e15: "1000000000000000", float("inf"): "Infinity", 4.5e15: "4500000000000000",
}


def test_number_text(spark):
    df = spark.createDataFrame([(k,) for k in NUMBER_TEXTS], "x double")
    rows = df.select("x", rendering.number_text(F.col("x"), T.DoubleType()).alias("t")).collect()
    assert {r["x"]: r["t"] for r in rows} == NUMBER_TEXTS
    single = spark.createDataFrame([(0.1,), (1e-4,), (16777216.0,)], "x float")
    texts = [r[0] for r in single.select(rendering.number_text(F.col("x"), T.FloatType())).collect()]
    assert texts == ["0.1", "0.0001", "16777216"]


def test_instants_and_json(spark):
    df = spark.sql(
        "select timestamp_ntz'2024-01-01 00:00:07.179575' as t, date'2024-01-15' as d,"
        " named_struct('a', 1, 'b', cast(null as int)) as s, array(1.5D, 2D, cast('NaN' as double)) as n,"
        " map('k', 'v') as m, true as b, unhex('00ff') as raw"
    )
    types = {f.name: f.dataType for f in df.schema.fields}
    row = df.select(*[rendering.text_of(F.col(c), types[c]).alias(c) for c in df.columns]).first()
    assert row.asDict() == {
        "t": "2024-01-01T00:00:07.179Z", "d": "2024-01-15T00:00:00.000Z", "s": '{"a":1,"b":null}',
        "n": "[1.5,2,null]", "m": '{"k":"v"}', "b": "true", "raw": "AP8=",
    }


COPY_CASES = ["plain", "", "a\\b", "tab\there", "line\nbreak", "return\r", "\\N", "\\t", "\\\\n\t\\", None]


def test_copy_cells_come_back(spark):
    df = spark.createDataFrame([(c,) for c in COPY_CASES], "text string")
    cells = df.select("text", rendering.copy_cell(F.col("text"), T.StringType()).alias("cell"))
    for row in cells.select("*", rendering.copy_cell_text(F.col("cell"), T.StringType()).alias("back")).collect():
        assert row["text"] == row["back"]
        assert not set("\t\n\r") & set(row["cell"])
    golden = {r["text"]: r["cell"] for r in cells.collect()}
    assert golden[None] == "\\N"
    assert golden["\\N"] == "\\\\N"
    assert golden["line\nbreak"] == "line\\nbreak"


def test_sql_literals(spark):
    df = spark.sql("select 'O''Reilly' as s, true as b, cast('NaN' as double) as x, cast(null as int) as i, 5 as n")
    types = {f.name: f.dataType for f in df.schema.fields}

    def literals(dialect):
        return list(df.select(*[rendering.sql_literal(F.col(c), types[c], dialect) for c in df.columns]).first())

    assert literals("postgres") == ["'O''Reilly'", "TRUE", "NULL", "NULL", "5"]
    assert literals("mysql") == ["'O''Reilly'", "1", "NULL", "NULL", "5"]
    assert rendering.quote_identifier('a"b', "postgres") == '"a""b"'
    assert rendering.quote_identifier("a`b", "mysql") == "`a``b`"


MASKS = [
    ("hello", {}, "*****"),
    ("hello@example.com", {"start": 2}, "he***************"),
    ("hello@example.com", {"end": 4}, "*************.com"),
    ("hello@example.com", {"start": 2, "end": 4}, "he***********.com"),
    ("secret", {"char": "#"}, "######"),
    ("abc", {"start": 2, "end": 1}, "***"),
    ("", {"start": 2}, ""),
    (None, {}, None),
]


def test_masks(spark):
    for text, options, expected in MASKS:
        df = spark.createDataFrame([(text,)], "text string")
        assert df.select(mask(F.col("text"), **options)).first()[0] == expected


def test_labels_and_counts(spark):
    df = spark.createDataFrame([(None,), ("x" * 80,), ("y" * 81,)], "text string")
    labels = [r[0] for r in df.select(rendering.chart_label(F.col("text"), 80)).collect()]
    assert labels == ["(null)", "x" * 80, "y" * 77 + "..."]
    whole = [r[0] for r in df.select(rendering.chart_label(F.col("text"))).collect()]
    assert len(whole[2]) > 80 and "..." not in whole[2]
    counts = spark.createDataFrame([(3.7,), (-1.0,), (float("nan"),), (None,)], "n double")
    assert [r[0] for r in counts.select(rendering.whole_count(F.col("n"))).collect()] == [3, None, None, None]


def test_fakes_are_null_for_null_and_shaped(spark):
    df = spark.createDataFrame([("ann",), ("bob",), (None,)], "text string")
    hashed = df.withColumn("h", fakes.digest(("1", "t", "c"), F.col("text")))
    made = hashed.select(
        "text",
        *[make(F.col("h")).alias(name.split(":")[1]) for name, make in fakes.FAKES.items()],
        fakes.number(F.col("h"), 100, 200).alias("number"),
        fakes.sentence(F.col("h"), 12).alias("short"),
        fakes.two_sentences(F.col("h")).alias("long"),
        fakes.zip_code(F.col("h")).alias("zip"),
        fakes.url(F.col("h")).alias("url"),
        fakes.boolean(F.col("h")).alias("flag"),
        fakes.recent_instant(F.col("h")).alias("at"),
    )
    rows = {r["text"]: r.asDict() for r in made.collect()}
    assert all(v is None for v in rows[None].values())
    for name in ("ann", "bob"):
        row = rows[name]
        assert "@" in row["email"] and 100 <= row["number"] <= 200 and len(row["short"]) <= 12
        assert len(row["uuid"]) == 36 and row["uuid"][14] == "4" and row["uuid"][19] in "89ab"
        assert row["long"].count(".") == 2 and len(row["zip"]) == 5
    assert rows["ann"]["email"] != rows["bob"]["email"]
    again = {r["text"]: r.asDict() for r in made.repartition(3).collect()}
    assert again == rows


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (-math.inf,), (None,)], "x double")
    assert [r[0] for r in df.select(parsing.finite(F.col("x"))).collect()] == [1.0, None, None, None, None]
