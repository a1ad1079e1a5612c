"""Comparison of a Spark result with the same query run by DuckDB."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


TYPE_NAMES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
    "date": "DATE", "array<float>": "FLOAT[]",
}


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between both results: names, types, rows; empty if nothing does."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = _bag(names, result.fetchall())
    actual = _bag(df.columns, df.collect())
    found = []
    if sorted(names) != sorted(df.columns):
        found.append(f"columns {sorted(df.columns)} != {sorted(names)}")
    for name, spark_type in df.dtypes:
        wanted = TYPE_NAMES.get(spark_type, spark_type.upper().replace("DECIMAL(10,2)", "DECIMAL(10,2)"))
        if name in types and types[name] != wanted:
            found.append(f"type of {name}: {spark_type} != {types[name]}")
    if expected != actual:
        found.append(
            f"rows {sum(actual.values())} vs {sum(expected.values())}; "
            f"only Spark {str(list((actual - expected).items())[:2])[:600]}; "
            f"only SQL {str(list((expected - actual).items())[:2])[:600]}"
        )
    return found
