"""Versioned tables: all of a change or nothing, and files that stay."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.operators import ingest, key_index, mutate, normalize, rewrite
from tablekit.plans.contract import Contract
from tablekit.sources.versions import VersionConflict, Versions

ITEMS = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
CONTRACT = Contract("items", ITEMS, ("id",))


@pytest.fixture
def versions(spark, tmp_path):
    return Versions(spark, str(tmp_path / "with space"))


def items(spark, n, shift=0):
    return spark.range(shift, n + shift).select("id", F.concat(F.lit("n"), F.col("id")).alias("name"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_no_version_yet(versions):
    assert versions.numbers() == [] and versions.version().files == {}
    with pytest.raises(KeyError):
        versions.table("items")


def test_second_writer_is_refused(spark, versions):
    before = versions.version()
    files = versions.write(items(spark, 5))
    versions.publish({"items": files}, {"items": ITEMS}, before)
    with pytest.raises(VersionConflict):
        versions.publish({"items": []}, {"items": ITEMS}, before)
    assert versions.numbers() == [1] and len(rows(versions.table("items"))) == 5


def test_old_versions_stay_readable(spark, versions):
    first = rewrite.create(versions, "items", items(spark, 3))
    rewrite.create(versions, "items", items(spark, 0))
    assert rows(versions.table("items")) == [] and len(rows(versions.table("items", first.number))) == 3


def patch_of(spark, edits):
    requests = spark.createDataFrame(
        [({"id": str(i)}, {"name": name}, n) for n, (i, name) in enumerate(edits)],
        "identity map<string,string>, values map<string,string>, at int",
    )
    return mutate.latest_patch(mutate.validate_rows(requests, CONTRACT, mutate.UPDATE), CONTRACT, "at")


def test_update_rewrites_only_touched_files(spark, versions):
    first = rewrite.create(versions, "items", items(spark, 1000), ["id"], files=5)
    assert len(first.files["items"]) > 2
    second = rewrite.update_files(versions, "items", patch_of(spark, [(3, "x"), (5, "y"), (3, "z"), (5000, "none")]), CONTRACT)
    kept = set(first.files["items"]) & set(second.files["items"])
    assert len(kept) == len(first.files["items"]) - 1
    want = {i: f"n{i}" for i in range(1000)} | {3: "z", 5: "y"}
    assert rows(versions.table("items")) == sorted(want.items())
    assert rows(versions.table("items", first.number))[3] == (3, "n3")


def test_update_without_a_row_publishes_nothing(spark, versions):
    rewrite.create(versions, "items", items(spark, 10))
    assert rewrite.update_files(versions, "items", patch_of(spark, [(77, "x")]), CONTRACT).number == 1
    empty = rewrite.update_files(versions, "items", patch_of(spark, []).where("1 = 0"), CONTRACT)
    assert empty.number == 1 and versions.numbers() == [1]


# ------------------------------------------------------------ one-pass import


def checked(spark, lines):
    raw = spark.createDataFrame(lines, "id string, name string, at int")
    return ingest.check_rows(raw, CONTRACT, {"id": "id", "name": "name"}, ["at"])


def test_import_publishes_good_rows_and_rejects_together(spark, versions):
    lines = [("1", "a", 0), ("x", "b", 1), ("1", "c", 2), ("2", "d", 3)]
    version, counts = rewrite.publish_import(checked(spark, lines), versions, "items")
    assert counts == {"successful_rows": 2, "failed_rows": 2} and version.number == 1
    assert rows(versions.table("items")) == [(1, "a"), (2, "d")]
    rejects = versions.table("items_rejects")
    assert rejects.columns == ["id", "name", ingest.REASON]
    assert [r[:2] for r in rows(rejects)] == [("1", "c"), ("x", "b")]
    _, counts = rewrite.publish_import(checked(spark, [("3", "e", 0)]), versions, "items")
    assert counts == {"successful_rows": 1, "failed_rows": 0}
    assert len(rows(versions.table("items"))) == 3 and len(rows(versions.table("items_rejects"))) == 2


def test_failed_import_publishes_neither(spark, versions, monkeypatch):
    rewrite.publish_import(checked(spark, [("1", "a", 0)]), versions, "items")
    monkeypatch.setattr(versions, "files_of", lambda folder: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        rewrite.publish_import(checked(spark, [("2", "b", 0), ("y", "c", 1)]), versions, "items")
    assert versions.numbers() == [1] and rows(versions.table("items")) == [(1, "a")]


def test_empty_import(spark, versions):
    _, counts = rewrite.publish_import(checked(spark, []), versions, "items")
    assert counts == {"successful_rows": 0, "failed_rows": 0} and rows(versions.table("items")) == []


# ------------------------------------------------------------------ key index


def files_read(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def test_key_index_reads_the_parts_of_its_keys(spark, tmp_path):
    index = key_index.KeyIndex(spark, str(tmp_path / "keys"), CONTRACT, parts=64)
    wanted = items(spark, 3, 10_000).withColumnRenamed("id", "k")
    assert index.among(wanted, ["k"], 0) is None
    read = []
    for batch in range(10):
        held = index.among(wanted, ["k"], batch)
        if held is not None:
            assert held.columns == ["id"]
            read.append(held.count())
        index.add(items(spark, 200, batch * 200), batch)
    assert max(read) <= 64 * 3 and read[-1] < 1800 * 3 * 3 / 64
    assert rows(index.among(items(spark, 5, 195), ["id"], 1).where("id >= 195")) == [(i,) for i in range(195, 200)]


def test_key_index_replay_sees_earlier_batches_only(spark, tmp_path):
    index = key_index.KeyIndex(spark, str(tmp_path / "keys"), CONTRACT)
    for _ in range(2):
        assert rows(index.among(items(spark, 3), ["id"], 1) or items(spark, 0)) == []
        index.add(items(spark, 0), 0)
        index.add(items(spark, 3), 1)
    assert rows(index.among(items(spark, 9), ["id"], 2)) == [(0,), (1,), (2,)]


# ------------------------------------------------------------- flat to tables

FLAT = "email string, first string, city string, ref string, total double, sku string, item string, qty int, carrier string"
ENTITIES = [
    normalize.Entity("line", ("ref", "sku"), ("qty",), ("orders", "product"), frozenset({"orders", "product"})),
    normalize.Entity("orders", ("ref",), ("total",), ("person", "carrier"), frozenset({"person"})),
    normalize.Entity("person", ("email",), ("first", "city")),
    normalize.Entity("product", ("sku",), ("item",)),
    normalize.Entity("carrier", ("carrier",)),
]
GOOD_FLAT = [
    ("a@x", "Ann", "Oslo", "R1", 30.0, "S1", "Pen", 1, "Post"),
    ("a@x", "Ann", "Oslo", "R1", 30.0, "S2", "Ink", 2, "Post"),
    ("b@x", None, "Rome", "R2", 10.0, "S1", "Pen", 1, None),
    ("b@x", None, "Rome", "R2", 10.0, "S1", "Pen", 1, None),
]


def test_flat_table_is_split_parents_first(spark, versions):
    split = normalize.normalize_flat(spark.createDataFrame(GOOD_FLAT, FLAT), ENTITIES)
    assert [*split.tables].index("person") < [*split.tables].index("orders") < [*split.tables].index("line")
    assert split.conflicts.collect() == []
    version = split.publish(versions)
    assert {n: versions.table(n).count() for n in version.files} == {"person": 2, "product": 2, "carrier": 1, "orders": 2, "line": 3}
    line, orders = versions.table("line"), versions.table("orders")
    person = versions.table("person")
    back = line.join(orders, "orders_id").join(person, "person_id").select("email", line["ref"], "sku", "qty")
    assert rows(back) == sorted({(r[0], r[3], r[5], r[7]) for r in GOOD_FLAT})
    assert orders.where("carrier_id is null").select("ref").collect()[0][0] == "R2"


@pytest.mark.parametrize(
    ("row", "table", "reason"),
    [
        (("a@x", "Anna", "Oslo", "R1", 30.0, "S1", "Pen", 1, "Post"), "person", normalize.CONTRADICTION),
        (("a@x", None, "Oslo", "R1", 30.0, "S1", "Pen", 1, "Post"), "person", normalize.CONTRADICTION),
        (("b@x", None, "Rome", "R1", 30.0, "S1", "Pen", 1, "Post"), "orders", normalize.CONTRADICTION),
        (("a@x", "Ann", "Oslo", "R1", 30.0, None, None, 1, "Post"), "line", normalize.INCOMPLETE),
        ((None, None, None, "R9", 1.0, "S1", "Pen", 1, "Post"), "orders", normalize.LOST_PARENT),
    ],
)
def test_conflict_publishes_nothing(spark, versions, row, table, reason):
    split = normalize.normalize_flat(spark.createDataFrame([*GOOD_FLAT, row], FLAT), ENTITIES)
    assert (table, reason) in {(r.table_name, r.reason) for r in split.conflicts.collect()}
    with pytest.raises(normalize.ConflictError, match=table):
        split.publish(versions)
    assert versions.numbers() == []


def test_colliding_surrogates_are_found(spark, monkeypatch):
    monkeypatch.setattr(normalize, "surrogate_key", lambda flat, key, table: F.lit("same"))
    split = normalize.normalize_flat(spark.createDataFrame(GOOD_FLAT, FLAT), [ENTITIES[2]])
    assert [r.reason for r in split.conflicts.collect()] == [normalize.COLLISION]


def test_entities_are_checked(spark):
    flat = spark.createDataFrame(GOOD_FLAT, FLAT)
    for wrong in (
        [normalize.Entity("a", ("nope",))],
        [normalize.Entity("a", ("ref",), parents=("b",)), normalize.Entity("b", ("sku",), parents=("a",))],
        [normalize.Entity("a", ())],
        [normalize.Entity("a", ("ref",), required=frozenset({"b"}))],
    ):
        with pytest.raises(ValueError):
            normalize.normalize_flat(flat, wrong)


def test_empty_flat_table(spark, versions):
    split = normalize.normalize_flat(spark.createDataFrame([], FLAT), ENTITIES)
    split.publish(versions)
    assert versions.table("line").count() == 0
