from __future__ import annotations

import random

import pytest
from conftest import plan_of
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.operators import chart as charts
from tablekit.operators import generate, ingest, lookup, mutate, quality, view
from tablekit.operators.anonymize import Rule, anonymize
from tablekit.plans.contract import Contract, ForeignKey
from tablekit.plans.requests import ChartRequest, Filter, PageRequest, Sort, resolve_page
from tablekit.sources import storage
from tablekit.streaming import import_stream

# ---------------------------------------------------------------- anonymize


def test_rules_touch_their_column_only(spark):
    df = spark.createDataFrame([(1, "a@x.org", "pw", "on"), (2, None, "pw", None)], "id int, email string, password string, status string")
    rules = [
        Rule("users", "email", "faker:email"), Rule("users", "password", "redact"),
        Rule("orders", "status", "null"), Rule("users", "missing", "redact"),
    ]
    first, second = anonymize(df, "users", rules, 5).orderBy("id").collect()
    assert first["email"].endswith("@example.com") and second["email"] is None
    assert first["password"] == "[REDACTED]" and (first["status"], first["id"]) == ("on", 1)


def test_equal_values_get_equal_fakes_per_column_and_seed(spark):
    df = spark.createDataFrame([("ann", "ann"), ("ann", "bob")], "p string, q string")
    rules = [Rule("t", "p", "faker:uuid"), Rule("t", "q", "faker:uuid")]
    one, two = anonymize(df, "t", rules, 1).collect()
    assert one["p"] == two["p"] != one["q"] != two["q"]
    assert anonymize(df, "t", rules, 2).first()["p"] != one["p"]
    shared = [Rule("t", c, "faker:uuid", scope="people") for c in ("p", "q")]
    one = anonymize(df, "t", shared, 1).first()
    assert one["p"] == one["q"]


@pytest.mark.parametrize("bad", [{"method": "faker:cat"}, {"method": "mask", "preserve_start": -1},
                                 {"method": "faker:number", "low": 2, "high": 1}, {"method": "faker:text", "max_length": 0}])
def test_bad_rules(bad):
    with pytest.raises(ValueError):
        Rule("t", "c", **bad)


# ------------------------------------------------------------------- charts


def points(df, **changes):
    request = ChartRequest(**{"table": "t", "aggregation": "sum", "metric": "v", "dimension": "d", **changes})
    rows = charts.chart(df, "t", request).orderBy("position").collect()
    return [(r["x"], r["y"]) for r in rows], {r["truncated"] for r in rows}


def test_points_and_truncation(spark):
    df = spark.createDataFrame([("A", 30), ("B", 20), ("C", 10), ("C", None)], "d string, v int")
    assert points(df, limit=2) == ([("A", 30.0), ("B", 20.0)], {True})
    assert points(df, limit=3) == ([("A", 30.0), ("B", 20.0), ("C", 10.0)], {False})
    assert points(df, aggregation="count", metric=None, limit=1) == ([("C", 2.0)], {True})


def test_group_after_the_limit_fills_a_gap(spark):
    df = spark.createDataFrame([(None, None), ("B", 2.0), ("C", float("nan"))], "d string, v double")
    # NaN sorts above all numbers; it is dropped after the cut at three groups.
    assert points(df, limit=2) == ([("B", 2.0)], {True})
    assert points(df, aggregation="count", limit=5)[0] == [("B", 1.0), ("C", 1.0), ("(null)", 0.0)]


# -------------------------------------------------------------------- pages


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(3)
    rows = [
        (i, rng.choice([None, "ab_c", "AB%C", "x\\y", "zz"]), rng.choice([None, 1.5, 2.0]), rng.choice([True, False, None]))
        for i in range(300)
    ]
    return spark.createDataFrame(rows, "id long, name string, price double, ok boolean").repartition(5)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_pages_cover_all_rows_once(items):
    contract = Contract("items", items.schema, ("id",))
    sorts = [Sort("name", True), Sort("price")]
    seen, after = [], []
    page = None
    for index in range(4):
        result = view.table_page(items, contract, PageRequest("items", index, 90, sorts))
        seen += rows_of(result.rows)
        page = result.page
        last = dict(zip(items.columns, seen[-1], strict=True))
        after.append(rows_of(view.page_rows_after(items, resolve_page(PageRequest("items", 0, 90, sorts), "items", items.schema), last, ("id",))))
    everything = rows_of(items)
    assert sorted(seen) == sorted(everything, key=lambda r: r[0]) and len(seen) == 300
    # None is last when descending and first when ascending.
    wanted = sorted(everything, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
    wanted = sorted(wanted, key=lambda r: r[1] or "", reverse=True)
    assert seen == wanted
    assert after[:3] == [seen[90:180], seen[180:270], seen[270:]] and after[3] == []
    assert page.index == 3


@pytest.mark.parametrize(("column", "value", "test"), [
    ("id", "7", lambda r: r[0] == 7),
    ("id", " 7.0", lambda r: r[0] == 7),
    ("id", "7.5", lambda r: False),
    ("id", "1e30", lambda r: False),
    ("price", "2", lambda r: r[2] == 2.0),
    ("ok", "YES", lambda r: r[3] is True),
    ("ok", "0", lambda r: r[3] is False),
    ("name", "B_C", lambda r: r[1] in ("ab_c", "AB%C")),
    ("name", "b%c", lambda r: r[1] in ("ab_c", "AB%C")),
    ("name", "\\", lambda r: r[1] == "x\\y"),
])
def test_filters(items, column, value, test):
    contract = Contract("items", items.schema, ("id",))
    result = view.table_page(items, contract, PageRequest("items", 0, 200, filters=[Filter(column, value)]))
    wanted = [r for r in rows_of(items) if test(r)]
    assert sorted(r[0] for r in rows_of(result.rows)) == sorted(r[0] for r in wanted)[:200]
    total = result.total.first()
    assert total["total_rows"] == len(wanted)
    assert total["page_count"] == -(-len(wanted) // 200)


@pytest.mark.parametrize(("column", "value"), [("id", "x"), ("price", "1d"), ("ok", "y")])
def test_filters_that_make_no_sense(items, column, value):
    contract = Contract("items", items.schema, ("id",))
    with pytest.raises(ValueError, match=column):
        view.table_page(items, contract, PageRequest("items", filters=[Filter(column, value)]))


def test_page_plan(spark, folder):
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    contract = Contract("orders", orders.schema, ("o_orderkey",))
    result = view.table_page(orders, contract, PageRequest("orders", 2, 25, filters=[Filter("o_custkey", "7")]))
    assert "EqualTo(o_custkey,7)" in plan_of(result.rows)
    assert "TakeOrderedAndProject(limit=75" in plan_of(result.rows)
    assert "ReadSchema: struct<o_custkey:bigint>" in plan_of(result.total)
    last = orders.where("o_orderkey = 700").first().asDict()
    page = resolve_page(PageRequest("orders", sorts=[Sort("o_custkey")]), "orders", orders.schema)
    later = view.page_rows_after(orders, page, last, ("o_orderkey",))
    assert f"GreaterThanOrEqual(o_custkey,{last['o_custkey']})" in plan_of(later)


# ------------------------------------------------------------------- lookup


@pytest.mark.parametrize("how", ["left", "inner"])
def test_all_ways_of_attaching_agree(spark, how):
    """A third of the rows has one key, a tenth has none."""
    rows = spark.range(3000).select(
        "id",
        F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 400).alias("k"),
    )
    facts = lookup.key_counts(rows, ["k"], F.max("id").alias("top")).where("k % 2 = 1")
    wanted = {
        tuple(r) for r in rows.join(facts, "k", how).select("id", "k", "_n", "top").collect()
    }
    ways = [
        lookup.attach(rows, facts, ["k"], how),
        lookup.attach_shuffled(rows, facts, ["k"], how),
        lookup.attach_shuffled(rows, facts, ["k"], how, hot_keys=1),
    ]
    for df in ways:
        got = [tuple(r) for r in df.select("id", "k", "_n", "top").collect()]
        assert set(got) == wanted and len(got) == len(wanted)


def test_size_check(spark, monkeypatch):
    df = spark.range(100)
    assert lookup.is_small(df)
    monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", 99)
    assert not lookup.is_small(df)
    monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", 1000)
    monkeypatch.setattr(lookup, "MAX_BROADCAST_BYTES", 100)
    assert not lookup.is_small(df)


# ------------------------------------------------------------------ quality


def test_key_and_orphan_checks(spark):
    child = spark.createDataFrame([(1, 1), (1, 9), (2, 9), (None, None), (3, 8)], "id int, parent int")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    report = quality.key_report(child, Contract("child", child.schema, ("id",))).first()
    assert (report["row_count"], report["null_key_rows"], report["duplicate_keys"], report["surplus_rows"]) == (5, 1, 1, 1)
    key = ForeignKey("parent", "parent", "id")
    orphans = quality.orphan_report(child, "child", key, parent).first()
    assert (orphans["orphan_values"], orphans["orphan_rows"]) == (2, 3)
    assert sorted(r["parent"] for r in quality.orphan_rows(child, key, parent).collect()) == [8, 9, 9]
    with pytest.raises(ValueError, match="no primary key"):
        quality.key_report(child, Contract("child", child.schema))
    counts = quality.child_counts(parent, "id", child, "parent").orderBy("id").collect()
    assert [r["child_count"] for r in counts] == [1, 0]


# ------------------------------------------------------------------- ingest

ITEMS = (
    T.StructType()
    .add("id", T.LongType())
    .add("owner", T.IntegerType())
    .add("state", T.StringType())
    .add("price", T.DoubleType())
)
ITEM_CONTRACT = Contract(
    "items", ITEMS, ("id",), (ForeignKey("owner", "people", "id"),), {"state": ("new", "old")}, frozenset({"state"})
)


def expected_reasons(records, owners, present):
    """Reasons by the rules, one record after the other."""
    taken, reasons = set(present), []
    for r in records:
        reason = None
        if not r["id"].isdigit():
            reason = "Invalid bigint value in column id."
        elif not r["owner"].isdigit():
            reason = "Invalid int value in column owner."
        elif r["price"] == "x":
            reason = "Invalid double value in column price."
        elif r["state"] not in ("new", "old"):
            reason = "Value not allowed in column state."
        elif int(r["owner"]) not in owners:
            reason = "Column owner refers to no row of people.id."
        elif int(r["id"]) in taken:
            reason = "Duplicate key (id)."
        else:
            taken.add(int(r["id"]))
        reasons.append(reason)
    return reasons


@pytest.fixture(scope="module")
def records():
    rng = random.Random(11)
    return [
        {
            "id": rng.choice(["7"] * 10 + [str(n) for n in range(20)] + ["", "q"]),
            "owner": rng.choice(["1"] * 10 + ["2", "3", "77", "78", "z"]),
            "state": rng.choice(["new", "old", "new", "old", "odd", ""]),
            "price": rng.choice(["1.5", "2", "x"]),
        }
        for _ in range(600)
    ]


@pytest.mark.parametrize("broadcast", [True, False])
def test_reasons_match_row_by_row_import(spark, records, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", 0)
        monkeypatch.setattr(lookup, "HOT_KEYS", 2)
    raw = spark.createDataFrame([Row(at=i, **r) for i, r in enumerate(records)]).repartition(5)
    people = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    target = spark.createDataFrame([(3,), (19,)], "id long")
    mapping = {c: c for c in ("id", "owner", "state", "price")}
    checked = ingest.check_rows(raw, ITEM_CONTRACT, mapping, ["at"], {"people": people}.__getitem__, target)
    got = {r["at"]: r["_error_reason"] for r in checked.rows.select("at", "_error_reason").collect()}
    assert [got[i] for i in range(len(records))] == expected_reasons(records, {1, 2, 3}, {3, 19})
    metrics = checked.metrics.first()
    assert (metrics["successful_rows"], metrics["failed_rows"]) == (checked.good.count(), checked.rejects.count())
    assert checked.good.dtypes == [("id", "bigint"), ("owner", "int"), ("state", "string"), ("price", "double")]
    assert checked.rejects.columns == ["id", "owner", "state", "price", "_error_reason"]


def test_keys_of_a_large_import_are_hashed_not_sorted(spark, monkeypatch):
    monkeypatch.setattr(lookup, "MAX_BROADCAST_ROWS", 0)
    stage, plans = storage.Stage(), []
    table = stage.table
    stage.table = lambda df, purpose: plans.append((purpose, plan_of(df))) or table(df, purpose)
    raw = spark.range(300).select(
        F.col("id").alias("at"), F.concat(F.lit("0"), F.col("id").cast("string")).alias("id"),
        (F.col("id") % 4).cast("string").alias("owner"), F.lit("new").alias("state"), F.lit("1.50").alias("price"),
    )
    people = spark.createDataFrame([(1,), (2,), (3,), (3,), (900,)], "id int")
    target = spark.range(298, 900).union(spark.range(298, 900))
    mapping = {c: c for c in ("id", "owner", "state", "price")}
    checked = ingest.check_rows(raw, ITEM_CONTRACT, mapping, ["at"], {"people": people}.__getitem__, target, stage)
    keys = [plan for purpose, plan in plans if purpose == "keys"]
    assert keys and not any(step in plan for plan in keys for step in ("SortAggregate", "SortMergeJoin"))
    assert sorted(r["id"] for r in checked.good.collect()) == [n for n in range(298) if n % 4]
    refused = {tuple(r) for r in checked.rejects.where("id >= 296").collect()}
    assert refused == {
        ("0296", "0", "new", "1.50", "Column owner refers to no row of people.id."),
        ("0298", "2", "new", "1.50", "Duplicate key (id)."), ("0299", "3", "new", "1.50", "Duplicate key (id)."),
    }
    stage.release()


def test_import_counts_while_writing(spark, tmp_path):
    (tmp_path / "in.csv").write_text('ID;Owner;STATE\n1;1;new\n1;1;"new;"\n2;1;old;9\n3;;old\n')
    people = spark.createDataFrame([(1,)], "id int")
    checked = ingest.import_csv(spark, str(tmp_path / "in.csv"), ITEM_CONTRACT, parents=lambda _: people)
    counts = ingest.write_import(checked, str(tmp_path / "good"), str(tmp_path / "bad"))
    assert counts == {"successful_rows": 1, "failed_rows": 3}
    with pytest.raises(Exception, match="(?i)not.*exist"):
        checked.good.collect()  # the staged rows are gone
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "good")).collect()] == [(1, 1, "new")]
    reasons = spark.read.csv(str(tmp_path / "bad"), header=True).select("ID", "_error_reason").collect()
    assert {tuple(r) for r in reasons} == {
        ("1", "Value not allowed in column state."), ("2", "Row has a wrong number of fields."),
        ("3", "Invalid int value in column owner."),
    }


def test_import_mappings(spark):
    raw = spark.createDataFrame([("1", "2", "new")], "a string, b string, c string").withColumn("at", F.lit(1))
    contract = Contract("items", ITEMS)
    later_wins = ingest.check_rows(raw, contract, {"a": "id", "b": "id", "c": ""}, ["at"])
    assert [tuple(r) for r in later_wins.good.collect()] == [(2,)]
    for mapping in ({"nope": "id"}, {"a": "nope"}):
        with pytest.raises(ValueError, match="nope"):
            ingest.check_rows(raw, contract, mapping, ["at"])
    for mapping in ({"a": ""}, {}):
        skipped = ingest.check_rows(raw, ITEM_CONTRACT, mapping, ["at"])
        assert tuple(skipped.metrics.first()) == (0, 0) and skipped.good.count() == 0
    needs_state = ingest.check_rows(raw, ITEM_CONTRACT, {"a": "id"}, ["at"])
    assert needs_state.rejects.first()["_error_reason"] == "Missing value in required column state."
    assert ingest.map_columns(raw, {}).count() == 0
    assert ingest.map_columns(raw, {"a": "x", "b": "x"}).columns == ["x"]


def test_stream_import_is_repeatable(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    people = spark.createDataFrame([(1,)], "id int")
    folders = import_stream.ImportFolders.under(str(tmp_path / "out"))

    def run():
        import_stream.import_stream(
            spark, str(source), ITEM_CONTRACT, folders, parents=lambda _: people, files_per_batch=1
        ).awaitTermination()
        return sorted(tuple(r)[:3] for r in import_stream.imported(spark, folders.good).select("id", "owner", "state").collect())

    (source / "a.csv").write_text("id,owner,state\n1,1,new\n2,5,new\n")
    assert run() == [(1, 1, "new")]
    assert run() == [(1, 1, "new")]
    (source / "b.csv").write_text("id,owner,state\n1,1,old\n3,1,old\n")
    assert run() == [(1, 1, "new"), (3, 1, "old")]
    rejects = import_stream.imported(spark, folders.rejects).select("id", "_error_reason").collect()
    assert {tuple(r) for r in rejects} == {
        ("2", "Column owner refers to no row of people.id."), ("1", "Duplicate key (id)."),
    }
    steps = import_stream.progress(spark, folders).orderBy("batch").collect()
    assert [(r["successful_rows"], r["failed_rows"]) for r in steps] == [(1, 1), (2, 2)]


# ------------------------------------------------------------------- mutate


def validated(spark, mode, *requests):
    schema = "n int, at int, values map<string,string>, identity map<string,string>"
    df = spark.createDataFrame([(i, i, *r) for i, r in enumerate(requests)], schema)
    return mutate.validate_rows(df, ITEM_CONTRACT, mode)


def test_insert_validation(spark):
    checked = validated(
        spark, "insert",
        ({"id": "5", "price": " 1e1 ", "state": " a "}, None),
        ({"id": "x", "who": "1"}, None),
        ({}, None),
        ({"price": " "}, None),
        ({"id": "1.5"}, None),
    )
    rows = checked.orderBy("n").collect()
    assert [r["error"] for r in rows] == [
        None, "Validation failed.", "No editable values were provided.", None, "Validation failed.",
    ]
    assert rows[1]["field_errors"] == {"id": "id must be numeric.", "who": "Unknown column."}
    assert rows[4]["field_errors"] == {"id": "id must fit type bigint."}
    made = mutate.insert_values(checked, ITEM_CONTRACT).collect()
    assert sorted(map(tuple, made), key=str) == sorted([(5, None, " a ", 10.0), (None, None, None, None)], key=str)


def test_update_validation_and_application(spark):
    base = spark.createDataFrame([(1, 1, "new", 1.0), (2, 2, "new", 2.0)], ITEMS)
    checked = validated(
        spark, "update",
        ({"state": "old", "price": "9"}, {"id": "1"}),
        ({"price": ""}, {"id": "1"}),
        ({"state": "old"}, {"id": "8"}),
        ({"id": "3"}, {"id": "1"}),
        ({"state": "x"}, {}),
        ({"state": "x"}, {"id": " "}),
        ({"state": "x"}, {"id": "q"}),
    )
    rows = checked.orderBy("n").collect()
    assert [r["error"] for r in rows] == [None, None, None, "Validation failed.", *["Invalid row identity."] * 3]
    assert [list(r["field_errors"].values()) for r in rows[3:]] == [
        ["Primary key columns cannot be edited."], ["Missing primary key value."],
        ["Primary key value cannot be null."], ["id must be numeric."],
    ]
    patch = mutate.latest_patch(checked, ITEM_CONTRACT, "at")
    assert sorted(map(tuple, mutate.apply_updates(base, patch, ITEM_CONTRACT).collect())) == [
        (1, 1, "old", None), (2, 2, "new", 2.0),
    ]
    assert [r["id"] for r in mutate.unmatched_updates(base, patch, ITEM_CONTRACT).collect()] == [8]
    with pytest.raises(ValueError, match="no primary key"):
        mutate.validate_rows(base, Contract("items", ITEMS), "update")


# ----------------------------------------------------------------- generate


def test_seeding_order_of_sources(spark):
    schema = T.StructType()
    for name, kind in (
        ("id", T.LongType()), ("author_id", T.IntegerType()), ("status_id", T.StringType()), ("status", T.StringType()),
        ("first_name", T.StringType()), ("email", T.StringType()), ("bio", T.StringType()), ("ratio", T.DoubleType()),
        ("active", T.BooleanType()), ("created", T.TimestampType()), ("other_id", T.LongType()), ("city", T.IntegerType()),
        ("serial", T.LongType()),
    ):
        schema = schema.add(name, kind)
    contract = Contract(
        "posts", schema, ("id",), (ForeignKey("author_id", "users", "id"), ForeignKey("status_id", "states", "id")),
        {"status": ("published",), "status_id": ("enum",)}, auto_increment=frozenset({"serial"}),
    )
    parents = {
        "users": spark.createDataFrame([(101,), (None,)], "id int"),
        "states": spark.createDataFrame([("s1",), ("s2",)], "id string"),
    }
    rows = generate.seed_table(spark, contract, 40, 3, parents.__getitem__).collect()
    assert len(rows) == 40 and "id" not in rows[0] and "serial" not in rows[0]
    assert {r["author_id"] for r in rows} == {101} and {r["status_id"] for r in rows} == {"s1", "s2"}
    assert {r["status"] for r in rows} == {"published"}
    assert all(1 <= r["other_id"] <= 100 and 0 <= r["city"] <= 1000 and 0 <= r["ratio"] <= 1000 for r in rows)
    assert all("@" in r["email"] and r["bio"].count(".") == 2 and r["created"] and r["active"] is not None for r in rows)
    again = generate.seed_table(spark, contract, 40, 3, parents.__getitem__).repartition(7).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_seeding_problems(spark):
    schema = T.StructType().add("kind", T.StringType()).add("owner", T.IntegerType())
    empty_domain = Contract("t", schema, enums={"kind": ()})
    with pytest.raises(ValueError, match="allowed values is empty"):
        generate.seed_table(spark, empty_domain)
    reference = Contract("t", schema, foreign_keys=(ForeignKey("owner", "people", "id"),))
    with pytest.raises(ValueError, match="people.id has no keys"):
        generate.seed_table(spark, reference, parents=lambda _: spark.createDataFrame([], "id int"))
    for count in (0, -1, 1.5, True):
        with pytest.raises(ValueError, match="positive"):
            generate.seed_table(spark, Contract("t", schema), count)
    assert generate.seed_table(spark, Contract("t", schema)).count() == 10


def test_pool_keeps_smallest_keys(spark):
    parent = spark.createDataFrame([(i,) for i in (5, 3, None, 9, 1)], "id int")
    assert sorted(map(tuple, generate.key_pool(parent, "id", 2).collect())) == [(0, 1), (1, 3)]
    assert sorted(generate.key_pool(parent, "id", None).select("_slot", "_key").collect()) == [(0, 1), (1, 3), (2, 5), (3, 9)]
