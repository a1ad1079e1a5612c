"""Requests for pages and charts, checked against a schema before any job runs."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from tablekit.functions import kinds
from tablekit.plans import limits

# The words a chart request may use.
CHART_TYPES = ("bar", "line")
MODES = ("dimension", "time")
AGGREGATIONS = ("count", "sum", "avg", "min", "max")
GRAINS = ("hour", "day", "month")
VOCABULARY = {"chart_type": CHART_TYPES, "mode": MODES, "aggregation": AGGREGATIONS}
DEFAULT_GRAIN = "day"


@dataclass(frozen=True)
class Sort:
    column: str
    descending: bool = False


@dataclass(frozen=True)
class Filter:
    column: str
    value: str


@dataclass(frozen=True)
class PageRequest:
    table: str
    page_index: float | None = 0
    page_size: float | None = limits.DEFAULT_PAGE_SIZE
    sorts: list[Sort] | None = None
    filters: list[Filter] | None = None


@dataclass(frozen=True)
class Page:
    """A page request in which every name is known and every number in range."""

    table: str
    index: int
    size: int
    sorts: tuple[Sort, ...] = field(default_factory=tuple)
    filters: tuple[Filter, ...] = field(default_factory=tuple)


@dataclass(frozen=True)
class ChartRequest:
    table: str
    aggregation: str
    mode: str = "dimension"
    chart_type: str = "bar"
    metric: str | None = None
    dimension: str | None = None
    time: str | None = None
    grain: str | None = None
    limit: float | None = None


@dataclass(frozen=True)
class Chart:
    table: str
    aggregation: str
    bucket: str
    metric: str | None
    grain: str | None
    limit: int


def _whole(value: Any) -> int | None:
    """The number cut toward zero, or None for anything that is not finite."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return math.trunc(value) if math.isfinite(value) else None


def clamp_index(value: Any) -> int:
    return max(0, _whole(value) or 0)


def clamp_size(value: Any, default: int, largest: int | None = None) -> int:
    """The number, at least 1; a caller that wants a largest one names it."""
    whole = _whole(value)
    if whole is None:
        return default
    return max(whole, 1) if largest is None else min(max(whole, 1), largest)


def _check_table(requested: Any, actual: str, purpose: str) -> None:
    if not isinstance(requested, str) or not requested.strip():
        raise ValueError("A table name is required.")
    if requested != actual:
        raise ValueError(f"Invalid table name for {purpose}.")


def resolve_page(
    request: PageRequest, table: str, schema: T.StructType, largest_page: int | None = None
) -> Page:
    """Numbers brought into range; sorts and filters that can't be used are dropped.

    All others count, however many. ``largest_page`` is for callers that bound pages.
    """
    _check_table(request.table, table, "a table page")
    known = set(schema.names)
    sorts = [
        sort for sort in request.sorts or [] if sort.column in known and isinstance(sort.descending, bool)
    ]
    kept = []
    for item in request.filters or []:
        value = item.value.strip() if isinstance(item.value, str) else ""
        if item.column in known and value:
            kept.append(Filter(item.column, value))
    return Page(
        table=table,
        index=clamp_index(request.page_index),
        size=clamp_size(request.page_size, limits.DEFAULT_PAGE_SIZE, largest_page),
        sorts=tuple(sorts),
        filters=tuple(kept),
    )


def _named(value: Any) -> str | None:
    return value if isinstance(value, str) and value.strip() else None


def _need(holds: bool, problem: str) -> None:
    if not holds:
        raise ValueError(problem)


def resolve_chart(
    request: ChartRequest, table: str, schema: T.StructType, most_points: int | None = None
) -> Chart:
    """A chart whose words, columns and kinds are all checked.

    ``most_points`` is for callers that bound the number of points.
    """
    _check_table(request.table, table, "a chart")
    for what in ("chart_type", "mode", "aggregation"):
        word = getattr(request, what)
        _need(word in VOCABULARY[what], f"No such {what.replace('_', ' ')}: {word}")

    kind_of = {f.name: kinds.kind_of(f.dataType) for f in schema.fields}
    metric = _named(request.metric)
    if request.aggregation != "count":
        measurable = kind_of.get(metric) == kinds.NUMERIC
        _need(measurable, f"A numeric metric is needed for {request.aggregation}, not {metric}")
    _need(metric is None or metric in kind_of, f"No such metric column: {metric}")

    over_time = request.mode == "time"
    bucket = _named(request.time if over_time else request.dimension)
    _need(bucket in kind_of, f"No such {'time' if over_time else 'dimension'} column: {bucket}")
    grain = None
    if over_time:
        _need(kind_of[bucket] == kinds.TEMPORAL, f"Column {bucket} holds no times")
        grain = request.grain if request.grain in GRAINS else DEFAULT_GRAIN
    points = clamp_size(request.limit, limits.DEFAULT_POINTS, most_points)
    return Chart(table, request.aggregation, bucket, metric, grain, points)
