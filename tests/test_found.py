"""Deep pages, key fakes, discovered keys and references, restored INSERT dumps."""

from __future__ import annotations

import random

import pytest
from conftest import plan_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import key_cipher, rendering
from tablekit.operators import deep_pages, discovery, dump, view
from tablekit.operators.anonymize import Rule, anonymize
from tablekit.plans.contract import Contract
from tablekit.plans.requests import Filter, PageRequest, Sort, resolve_page
from tablekit.registry.base import FOREIGN_KEYS, open_catalog
from tablekit.registry.found import COLUMNS
from tablekit.sources.catalog import Catalog
from tablekit.sources.insert_text import read_insert_text

# ----------------------------------------------------------------- deep pages


def numbers(spark, n=3000):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, *range(6)]), rng.choice([None, "a", "b", "c"])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a int, b string")


@pytest.mark.parametrize("sorts", [[Sort("a")], [Sort("a", True), Sort("b")], [Sort("b"), Sort("id", True)], [Sort("id")]])
@pytest.mark.parametrize("index", [0, 7, 60, 149, 150])
def test_deep_page_is_the_page(spark, sorts, index):
    df = numbers(spark)
    page = resolve_page(PageRequest("t", index, 20, sorts), "t", df.schema)
    want = view.page_rows(df, page, ("id",)).collect()
    assert deep_pages.deep_page_rows(df, page, ("id",), most_rows=100, pivots=5).collect() == want


def test_deep_page_of_equal_rows(spark):
    df = spark.range(500).select(F.lit(1).alias("a"), F.lit("x").alias("b"))
    page = resolve_page(PageRequest("t", 12, 20), "t", df.schema)
    assert len(deep_pages.deep_page_rows(df, page, most_rows=10).collect()) == 20


def test_range_of_a_deep_page_is_small(spark):
    df = numbers(spark)
    page = resolve_page(PageRequest("t", 100, 20, [Sort("a"), Sort("b")]), "t", df.schema)
    plan = view.sort_plan(df.schema, page.sorts, ("id",))
    place = deep_pages.page_range(df, page, plan, most_rows=200, pivots=8)
    assert place.rows <= 200 and place.skip < 200
    assert deep_pages.within(df, plan, place).count() == place.rows


@pytest.mark.parametrize("index", [7, 149, 10_000_000])
def test_table_page_far_into_a_table_sorts_no_rows_before_it(spark, monkeypatch, index):
    df = numbers(spark)
    request = PageRequest("t", index, 20, [Sort("a")])
    page = resolve_page(request, "t", df.schema)
    want = view.page_rows(df, page, ("id",)).collect() if index < 150 else []
    monkeypatch.setattr(deep_pages, "MOST_ROWS", 100)
    shown = view.table_page(df, Contract("t", df.schema, primary_key=("id",)), request)
    assert shown.rows.collect() == want and shown.total.first()["total_rows"] == 3000
    if not want:
        assert "Sort" not in plan_of(shown.rows) and "TakeOrdered" not in plan_of(shown.rows)


def test_deep_page_of_an_empty_table(spark):
    df = numbers(spark).where("id < 0")
    page = resolve_page(PageRequest("t", 0, 20), "t", df.schema)
    assert deep_pages.deep_page_rows(df, page).collect() == []


def test_page_with_total(spark):
    df = numbers(spark)
    request = PageRequest("t", 1, 10, [Sort("b", True)], [Filter("a", "3")])
    declared = Contract("t", df.schema, ("id",))
    counted = deep_pages.page_with_total(df, declared, request)
    both = view.table_page(df, declared, request)
    assert counted.rows.collect() == both.rows.collect() and counted.total == both.total.first()["total_rows"]
    none = deep_pages.page_with_total(df, declared, PageRequest("t", 0, 10, filters=[Filter("a", "77")]))
    assert none.rows.collect() == [] and none.total == 0


# ------------------------------------------------------------------ key fakes


@pytest.mark.parametrize("kind", [T.ByteType(), T.ShortType()])
def test_all_numbers_of_a_type_are_permuted(spark, kind):
    bits = {"tinyint": 8, "smallint": 16}[kind.simpleString()]
    every = spark.range(-(2 ** (bits - 1)), 2 ** (bits - 1)).select(F.col("id").cast(kind).alias("k"))
    fakes = [r.f for r in every.select(key_cipher.permuted_key(F.col("k"), kind, ("s",)).alias("f")).collect()]
    assert sorted(fakes) == list(range(-(2 ** (bits - 1)), 2 ** (bits - 1)))
    assert sum(i - 2 ** (bits - 1) == f for i, f in enumerate(fakes)) < 10


@pytest.mark.parametrize("below", [1, 2, 5, 1000, 1025])
def test_numbers_below_a_bound_are_permuted(spark, below):
    fake = key_cipher.permuted_key(F.col("id"), T.LongType(), ("s", "t"), below)
    assert sorted(r.f for r in spark.range(below).select(fake.alias("f")).collect()) == list(range(below))


def test_key_outside_the_bound_is_an_error(spark):
    fake = key_cipher.permuted_key(F.col("id"), T.LongType(), ("s",), 10)
    with pytest.raises(Exception, match=key_cipher.TOO_LONG):
        spark.range(11).select(fake).collect()


def test_key_fakes_join_and_keep_nulls(spark):
    rules = [
        Rule("a", "k", "faker:key", scope="x"), Rule("b", "r", "faker:key", scope="x"),
        Rule("a", "t", "faker:key"), Rule("a", "u", "faker:key"),
    ]
    a = spark.createDataFrame([(1, "p", 1), (2**63 - 1, "q", 1), (-5, None, 2)], "k long, t string, u int")
    b = spark.createDataFrame([(1,), (-5,), (None,)], "r long")
    left, right = anonymize(a, "a", rules, 3), anonymize(b, "b", rules, 3)
    assert left.schema["k"].dataType == T.LongType() and left.schema["u"].dataType == T.IntegerType()
    rows = left.collect()
    assert len({r.k for r in rows}) == 3 and rows[0].u == rows[1].u != rows[2].u and rows[2].t is None
    assert left.join(right, left["k"] == right["r"]).count() == 2
    assert {r.k for r in anonymize(a, "a", rules, 4).collect()}.isdisjoint({r.k for r in rows})
    assert [r.r for r in right.collect()][2] is None


def test_bound_of_key_fakes_is_checked():
    with pytest.raises(ValueError):
        Rule("a", "k", "faker:key", below=0)


# ------------------------------------------------------------------ discovery


def test_declared_references_are_found(spark, folder):
    catalog = open_catalog(spark, folder).select(list(COLUMNS))
    found = {(r.table_name, r.column_name, r.ref_table, r.ref_column) for r in discovery.discovered_references(catalog).collect()}
    declared = {(t, k.column, k.ref_table, k.ref_column) for t, keys in FOREIGN_KEYS.items() for k in keys}
    assert len(declared) == 8 and declared <= found


def test_references_of_many_columns_and_odd_values(spark):
    wide = spark.range(20).select("id", *[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(130)])
    texts = spark.createDataFrame([("a" * 100,), ("7",), (None,)], "t string")
    keys = spark.createDataFrame([("a" * 100,), ("7",), ("z",)], "k string")
    gaps = spark.createDataFrame([(1,), (None,)], "g long")
    empty = spark.createDataFrame([], "e long")
    catalog = Catalog.of({"wide": wide, "texts": texts, "keys": keys, "gaps": gaps, "empty": empty})
    found = {tuple(r)[:4] for r in discovery.discovered_references(catalog).collect()}
    inside = {("wide", f"c{i}", "wide", "id") for i in range(130)} | {("wide", f"c{i}", "wide", f"c{j}") for i in range(130) for j in range(19, 130) if i != j}
    want = inside | {("wide", "id", "wide", f"c{j}") for j in range(19, 130)}
    want |= {("texts", "t", "keys", "k"), ("gaps", "g", "wide", "id")} | {("gaps", "g", "wide", f"c{j}") for j in range(19, 130)}
    assert found == want


def test_smallest_keys_are_found(spark):
    pairs = spark.range(12).select((F.col("id") % 3).alias("a"), F.floor(F.col("id") / 3).alias("b"), F.lit("x").alias("c"))
    single = spark.range(5).select("id", (F.col("id") % 2).alias("odd"), F.when(F.col("id") > 0, F.col("id")).alias("gap"))
    none = spark.createDataFrame([(1, 1), (1, 1)], "a long, b long")
    catalog = Catalog.of({"pairs": pairs, "single": single, "none": none, "empty": none.limit(0)})
    assert [tuple(r) for r in discovery.discovered_keys(catalog).collect()] == [("pairs", "a,b", 2), ("single", "id", 1)]


def test_keys_that_one_repeat_spoils(spark):
    once = spark.range(5000).select("id", (F.col("id") * 7).alias("twice"), F.lit("c" * 100).alias("t"))
    once = once.withColumn("twice", F.when(F.col("id") == 4321, 7).otherwise(F.col("twice")))
    once = once.withColumn("t", F.concat("t", F.col("id").cast("string")))
    catalog = Catalog.of({"once": once})
    assert [r.key for r in discovery.discovered_keys(catalog).collect()] == ["id", "t"]


def test_sets_that_repeat_are_not_shuffled_whole(spark, monkeypatch):
    """Most pairs of columns are ruled out by a share of their values."""
    n = F.col("id")
    wide = spark.range(4000).select(*[(n % m).alias(f"m{m}") for m in (50, 80, 40, 20)], F.floor(n / 50).alias("f"))
    asked = []
    test = discovery._unrepeated

    def noted(df, sets, share):
        asked.append((share, len(sets)))
        return test(df, sets, share)

    monkeypatch.setattr(discovery, "_unrepeated", noted)
    got = [r.key for r in discovery.discovered_keys(Catalog.of({"wide": wide})).collect()]
    assert got == ["m50,f", "m80,f"]
    assert [share for share, _ in asked] == [64, 1, 64, 1]
    assert asked[2][1] == 10 and 2 <= asked[3][1] < 10


# --------------------------------------------------------------- INSERT dumps

ODD = "k long, t string, d double, f boolean, s timestamp_ntz, v array<double>, b binary, y date"


def odd_rows():
    from datetime import date, datetime

    texts = [
        "it's", "''", "'", "", "NULL", "a), (b", "x, y", "line\nbreak", "INSERT INTO \"odd\" VALUES (1);\n", ";\n", "\x1a\x1e\x1f\x1aR",
        "back\\slash \\' \\n", "é", "tab\t", None, "');\nINSERT INTO `odd` (`k`) VALUES ('", "\n\n", "-- x", "CREATE TABLE x (\n", ");", ");\n",
    ]
    when = datetime(2024, 2, 29, 1, 2, 3, 456789)
    return [(i, t, [1.5, None, 1e300][i % 3], [True, False, None][i % 3], when if i % 2 else None, [0.25, -1.0], b"\x00'", date(2020, 1, 2)) for i, t in enumerate(texts * 3)]


@pytest.mark.parametrize("dialect", rendering.DIALECTS)
@pytest.mark.parametrize("block", [None, "100"])
def test_insert_dump_comes_back(spark, tmp_path, dialect, block):
    df = spark.createDataFrame(odd_rows(), ODD)
    lines = dump.insert_statements(df, "odd", dialect, ("k",), batch_rows=4, micros=True)
    lines.select("statement").coalesce(2).write.option("lineSep", "\n").text(str(tmp_path / "out"))
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        back = read_insert_text(spark, str(tmp_path / "out"), "odd", df.schema, dialect, misfits=True)
        got = sorted(map(tuple, back.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((*r[:6], bytearray(r[6]), r[7], []) for r in odd_rows())


def test_dumps_of_other_programs(spark, tmp_path):
    text = r"""-- a dump; 'one' of many
CREATE TABLE `t` (
  `a` int,
  `b` text
);
INSERT INTO `t` VALUES (1,'it\'s'),(2,'a\\'),(3,NULL),
(4,'x\ny'),
(5,'two ''quotes''');
insert into `t` (`a`, `b`) values ( 6 , '), (' ) ;

UNLOCK TABLES;
INSERT INTO `other` VALUES (9,'no');
INSERT INTO `t` VALUES (7,''),('x','bad'),(8),(NULL,'end');
"""
    (tmp_path / "dump.sql").write_text(text)
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    rows = read_insert_text(spark, str(tmp_path / "dump.sql"), "t", schema, "mysql", backslashes=True, misfits=True).collect()
    want = {
        (1, "it's"), (2, "a\\"), (3, None), (4, "x\ny"), (5, "two 'quotes'"), (6, "), ("), (7, ""), (None, "bad"), (None, None), (None, "end"),
    }
    assert {(r.a, r.b) for r in rows} == want
    assert sorted(r._misfits for r in rows if r._misfits) == [["a"], ["a", "b"]]


def test_numbers_only_and_empty_dump(spark, tmp_path):
    df = spark.range(2500).select("id", (F.col("id") * 0.5).alias("x"))
    dump.insert_statements(df, "n", "sqlite", ("id",)).select("statement").write.text(str(tmp_path / "n"))
    assert sorted(map(tuple, read_insert_text(spark, str(tmp_path / "n"), "n", df.schema, "sqlite").collect())) == [(i, i / 2) for i in range(2500)]
    (tmp_path / "empty.sql").write_text("")
    assert read_insert_text(spark, str(tmp_path / "empty.sql"), "n", df.schema, "sqlite").collect() == []


def test_statements_are_shuffled_once(spark, tmp_path):
    (tmp_path / "d.sql").write_text("INSERT INTO \"n\" VALUES (1, 2);\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    plan = plan_of(read_insert_text(spark, str(tmp_path / "d.sql"), "n", schema, "sqlite"))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_wrong_arguments(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType())])
    for table, dialect, columns in (("t", "oracle", None), ("t", "mysql", ["b"]), ("t's", "mysql", None)):
        with pytest.raises(ValueError):
            read_insert_text(spark, str(tmp_path), table, schema, dialect, columns)


def test_copy_misfits_are_counted(spark):
    lines = spark.createDataFrame([("1\tx",), ("y\tz",), ("3",), ("\\N\t\\N",), ("4\t5\t6",)], "line string")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    rows = dump.copy_rows(lines, schema, misfits=True)
    assert [(r.a, r.b, r._misfits) for r in rows.collect()] == [
        (1, "x", []), (None, "z", ["a"]), (None, None, ["a", "b"]), (None, None, []), (None, None, ["a", "b"]),
    ]
    assert {tuple(r) for r in dump.misfit_counts(rows).collect()} == {("a", 3), ("b", 2)}
