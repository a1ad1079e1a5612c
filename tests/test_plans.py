from __future__ import annotations

import math

import pytest
from pyspark.sql import types as T

from tablekit.plans import naming
from tablekit.plans.contract import Contract, ForeignKey
from tablekit.plans.requests import (
    ChartRequest,
    Filter,
    PageRequest,
    Sort,
    clamp_index,
    clamp_size,
    resolve_chart,
    resolve_page,
)

ORDERS = (
    T.StructType()
    .add("id", T.IntegerType())
    .add("total", T.DecimalType(10, 2))
    .add("status", T.StringType())
    .add("created_at", T.TimestampType())
)
USERS = (
    T.StructType()
    .add("id", T.IntegerType())
    .add("email", T.StringType())
    .add("is_active", T.BooleanType())
)


@pytest.mark.parametrize(("given", "index", "size"), [
    (-4, 0, 1), (9999, 9999, 9999), (None, 0, 25), (math.nan, 0, 25), (math.inf, 0, 25), (2.9, 2, 2), ("3", 0, 25),
    (0, 0, 1), (True, 0, 25),
])
def test_clamps(given, index, size):
    assert clamp_index(given) == index
    assert clamp_size(given, 25) == size
    assert clamp_size(given, 25, 200) == min(size, 200)


def test_page_keeps_all_usable_entries():
    request = PageRequest(
        "users", -4, 9999,
        [Sort("nope"), Sort("email", True), Sort("id"), Sort("is_active")],
        [Filter("nope", "x"), Filter("email", "  a "), Filter("id", " "), *[Filter("id", "1")] * 8],
    )
    page = resolve_page(request, "users", USERS)
    assert (page.index, page.size) == (0, 9999)
    assert page.sorts == (Sort("email", True), Sort("id"), Sort("is_active"))
    assert page.filters == (Filter("email", "a"), *[Filter("id", "1")] * 8)
    assert resolve_page(request, "users", USERS, largest_page=200).size == 200


@pytest.mark.parametrize("name", ["orders", " ", None])
def test_page_for_another_table(name):
    with pytest.raises(ValueError):
        resolve_page(PageRequest(name), "users", USERS)


@pytest.mark.parametrize(("changes", "message"), [
    ({"table": ""}, "table name"),
    ({"table": "users"}, "Invalid table name"),
    ({"chart_type": "pie"}, "chart type"),
    ({"mode": "space"}, "mode"),
    ({"aggregation": "median"}, "aggregation"),
    ({"aggregation": "sum"}, "numeric metric"),
    ({"aggregation": "sum", "metric": "status"}, "numeric metric"),
    ({"metric": "nope"}, "metric column"),
    ({"dimension": "nope"}, "dimension column"),
    ({"mode": "time"}, "time column"),
    ({"mode": "time", "time": "status"}, "holds no times"),
])
def test_chart_problems(changes, message):
    request = ChartRequest(**{"table": "orders", "aggregation": "count", "dimension": "status", **changes})
    with pytest.raises(ValueError, match=message):
        resolve_chart(request, "orders", ORDERS)


def test_chart_defaults():
    chart = resolve_chart(
        ChartRequest("orders", "sum", "time", metric="total", time="created_at", grain="week", limit=99999),
        "orders", ORDERS,
    )
    assert (chart.grain, chart.limit, chart.bucket) == ("day", 99999, "created_at")
    counted = resolve_chart(ChartRequest("orders", "count", metric=" ", dimension="status"), "orders", ORDERS)
    assert (counted.metric, counted.limit, counted.grain) == (None, 120, None)


def test_names():
    assert naming.auto_map(["First Name", "E-Mail", "x"], ["first_name", "email"]) == {
        "First Name": "first_name", "E-Mail": "email",
    }
    assert naming.effective_mapping({"a": "x", "b": "", "c": "x"}) == {"x": "c"}
    assert naming.safe_file_name(" sales/orders ") == "sales_orders"
    assert naming.safe_file_name("...") == "database"
    assert naming.unique_file_names(["users"] * 3, ".csv") == ["users.csv", "users_2.csv", "users_3.csv"]


def test_contract():
    contract = Contract(
        "users", USERS, ("id",), (ForeignKey("email", "mails", "address"),), auto_increment=frozenset({"id"})
    )
    assert contract.writable() == ["email", "is_active"]
    assert contract.writable(for_update=True) == ["email", "is_active"]
    assert contract.must_have_value == {"id"}
    with pytest.raises(ValueError, match="nope"):
        Contract("users", USERS, ("nope",))
