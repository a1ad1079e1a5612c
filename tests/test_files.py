from __future__ import annotations

import glob
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.operators import dump
from tablekit.operators.anonymize import Rule
from tablekit.plans.contract import Contract
from tablekit.registry import writes
from tablekit.sources.catalog import Catalog
from tablekit.sources.copy_text import read_copy_text
from tablekit.sources.csv_files import (
    CORRUPT,
    csv_lines,
    layout_of,
    read_csv_text,
    sniff_csv,
    write_csv,
    write_database,
)


def write(path: Path, text: str) -> str:
    path.write_bytes(text.encode())
    return str(path)


def cells(df, *columns):
    return [tuple(r) for r in df.orderBy("_file", "_block", "_line").select(*columns).collect()]


def test_csv_text_is_exact(spark, tmp_path):
    df = spark.createDataFrame([(1, 'Jane "JJ"', "hello,world"), (2, None, "line1\nline2")], "id int, name string, notes string")
    assert [r["line"] for r in csv_lines(df).orderBy("line").collect()] == [
        '"1","Jane ""JJ""","hello,world"', '"2","","line1\nline2"',
    ]
    write_csv(df.coalesce(1), str(tmp_path / "out"))
    written = "".join(Path(p).read_text() for p in glob.glob(f"{tmp_path}/out/part-*"))
    assert written == '"id","name","notes"\n"1","Jane ""JJ""","hello,world"\n"2","","line1\nline2"\n'


def test_csv_keeps_spaces_returns_and_quotes(spark, tmp_path):
    rows = [("  a ", 'x"y', "1\r\n2"), ("", "\t", 'end"'), ("c\\", "\\", "d\r")]
    df = spark.createDataFrame(rows, "p string, q string, r string")
    write_csv(df, str(tmp_path / "out"))
    read = read_csv_text(spark, str(tmp_path / "out"))
    assert sorted(tuple(r)[:3] for r in read.collect()) == sorted(rows)


def test_reading_odd_lines(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,name,note\n1,x,\n\n2,"",y\n3,only two\n4,a,b,c\n5," s ","q""q"\n')
    read = read_csv_text(spark, path)
    assert cells(read.where(F.col(CORRUPT).isNull()), "id", "name", "note") == [
        ("1", "x", ""), ("2", "", "y"), ("5", " s ", 'q"q'),
    ]
    assert cells(read.where(F.col(CORRUPT).isNotNull()), "id", CORRUPT) == [("3", "3,only two"), ("4", "4,a,b,c")]


def test_windows_line_ends(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id;name\r\n1;a,b\r\n2;c\r\n")
    assert sniff_csv(spark, path).carriage_returns
    assert cells(read_csv_text(spark, path), "id", "name") == [("1", "a,b"), ("2", "c")]


def test_header_oddities(spark, tmp_path):
    path = write(tmp_path / "a.csv", " id ,,name,name\n1,skip,first,second\n")
    layout = sniff_csv(spark, path)
    assert (layout.headers, layout.literal) == (["id", "name"], False)
    assert cells(read_csv_text(spark, path, layout), "id", "name") == [("1", "second")]


@pytest.mark.parametrize(("line", "delimiter", "headers"), [
    ("a,b;c,d", ",", ["a", "b;c", "d"]),
    ("a;b;c,d", ";", ["a", "b", "c,d"]),
    ("a;b,c", ",", ["a;b", "c"]),
    ('"x,1",y', ",", ["x,1", "y"]),
    ("", ",", []),
])
def test_sniffing(line, delimiter, headers):
    layout = layout_of(line)
    assert (layout.delimiter, layout.headers) == (delimiter, headers)


def test_files_with_other_headers_are_refused(spark, tmp_path):
    write(tmp_path / "a.csv", "id,name\n1,x\n")
    write(tmp_path / "b.csv", "name,id\nx,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv_text(spark, str(tmp_path)).collect()


def test_database_export(spark, tmp_path):
    tables = {"a/b": spark.range(2), "a b": spark.range(3)}
    folders = write_database(Catalog.of(tables), str(tmp_path / "db"))
    assert folders == {"a b": "a_b.csv", "a/b": "a_b_2.csv"}
    assert read_csv_text(spark, f"{tmp_path}/db/a_b.csv").count() == 3


@pytest.mark.parametrize(("rows", "sizes"), [(3000, [1000] * 3), (2500, [1000, 1000, 500]), (0, []), (3, [3])])
def test_insert_batches(spark, rows, sizes):
    df = spark.range(0, rows, 1, 7).select((F.lit(rows) - F.col("id")).alias("id"))
    batches = dump.insert_statements(df, "t", "sqlite", ("id",)).orderBy("batch").collect()
    assert [b["statement"].count("(") - 1 for b in batches] == sizes
    numbers = [int(n.strip("() ")) for b in batches for n in b["statement"][:-1].split(" VALUES ")[1].split(",")]
    assert numbers == list(range(1, rows + 1))


def test_insert_text_and_unknown_dialect(spark):
    df = spark.createDataFrame([(1, "O'Reilly", None)], "id int, name string, flag boolean")
    statement = dump.insert_statements(df, "us`ers", "mysql", ("id",)).first()["statement"]
    assert statement == "INSERT INTO `us``ers` (`id`, `name`, `flag`) VALUES (1, 'O''Reilly', NULL);"
    with pytest.raises(ValueError, match="dialect"):
        dump.insert_statements(df, "t", "oracle")


def test_equal_rows_are_numbered_over_partitions(spark):
    """A third of all rows are copies of one row; every copy gets its own place."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"))
    numbered = dump.numbered_rows(df, ["v"], False, F.col("v")).collect()
    assert sorted(r["_index"] for r in numbered) == list(range(3000))
    by_place = [r["v"] for r in sorted(numbered, key=lambda r: r["_index"])]
    assert by_place == sorted(by_place)


def test_copy_files_with_frame_lines(spark, tmp_path):
    schema = T.StructType().add("id", T.LongType()).add("text", T.StringType())
    path = write(tmp_path / "t.txt", 'COPY "t" ("id", "text") FROM stdin;\n1\ta\\\\\\nb\n\\N\t\\N\n2\t\n\\.\n')
    rows = {tuple(r) for r in read_copy_text(spark, path, "t", schema).collect()}
    assert rows == {(1, "a\\\nb"), (None, None), (2, "")}


def test_dump_folders(spark, tmp_path):
    people = spark.createDataFrame([(1, "Ann"), (2, None)], "id int, name string")
    catalog = Catalog.of(
        {"people": people, "empty": people.limit(0)}, {"people": Contract("people", people.schema, ("id",))}
    )
    rules = [Rule("people", "name", "faker:firstName"), Rule("people", "id", "mask")]
    with pytest.raises(ValueError, match="rule"):
        dump.anonymized_dump(catalog, [], str(tmp_path / "none"), "postgres", 1)
    listing = dump.anonymized_dump(catalog, rules, str(tmp_path / "pg"), "postgres", 1)
    facts = {r["table_name"]: (r["row_count"], r["rule_count"], r["seed"], r["is_empty"]) for r in listing.collect()}
    assert facts == {"empty": (0, 0, "1", True), "people": (2, 2, "1", False)}
    assert not (tmp_path / "pg" / "empty").exists()
    lines = sorted(r[0] for r in spark.read.text(f"{tmp_path}/pg/people/2_data").collect())
    assert len(lines) == 2 and all(line.startswith("*\t") for line in lines)
    dump.anonymized_dump(catalog, rules, str(tmp_path / "my"), "mysql", 1, ["people"])
    statement = spark.read.text(f"{tmp_path}/my/people/2_data").first()[0]
    assert statement.startswith("INSERT INTO `people` (`id`, `name`) VALUES ('*', ")
    assert not (tmp_path / "my" / "people" / "1_header").exists()


def test_catalog(spark):
    catalog = Catalog.of({"b": spark.range(1), "a": spark.range(2)})
    assert catalog.names == ["a", "b"]
    assert catalog.select([]).names == ["a", "b"] and catalog.select(["a"]).names == ["a"]
    with pytest.raises(KeyError, match="Unknown tables: x"):
        catalog.select(["a", "x"])
    with pytest.raises(KeyError, match="Unknown table: c"):
        catalog.table("c")


@pytest.fixture
def tiny_blocks(spark):
    """Blocks of a few dozen bytes, so that lines cross many edges."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], "60")
    spark.conf.set(names[1], "1")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_files_read_alike_whole_and_in_blocks(spark, tmp_path, tiny_blocks):
    lines = [f'{i},5" pipe {i}' if i % 3 else f'{i},"a ""b"", c"' for i in range(60)]
    write(tmp_path / "stray.csv", "\n\nid,name\n" + "\n".join(lines) + "\n")
    wanted = [(str(i), f'5" pipe {i}' if i % 3 else 'a "b", c') for i in range(60)]
    for multi_line in (True, False):
        read = read_csv_text(spark, str(tmp_path), multi_line=multi_line)
        assert sorted(cells(read, "id", "name")) == sorted(wanted)


def test_ragged_lines_are_not_collected(spark, folder, monkeypatch):
    monkeypatch.setattr(writes.F, "collect_list", None)
    written = writes.write_faulty_files(spark, folder)
    files = glob.glob(written.removeprefix("file:").removesuffix("*") + "3_ragged/part-*")
    lines = [line for f in files for line in Path(f).read_text().splitlines()[1:]]
    heads = {Path(f).read_text().splitlines()[0] for f in files}
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    assert heads == {",".join(f'"{h}"' for h in [*writes.HEADERS.values(), writes.NOTE])}
    assert len(lines) == orders.where("o_orderkey % 71 = 0").count()
    assert all(line.endswith(',"ragged","extra"') for line in lines)
