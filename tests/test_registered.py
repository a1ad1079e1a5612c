"""Every registered query against the same query in SQL, on the smallest tables."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as driver
from tablekit.registry import all_queries

NAMES = sorted(query.name for query in all_queries())


@pytest.fixture(scope="module")
def con(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, folder, con, name):
    result = driver.queries()[name](spark, folder)
    assert oracle.differences(result, con, driver.oracle_sql()[name]) == []


def test_every_query_has_sql():
    assert set(NAMES) <= set(driver.oracle_sql())


def test_entry_has_rows(spark):
    rows = driver.entry(spark).collect()
    assert [row["position"] for row in rows] == list(range(1, len(rows) + 1))
