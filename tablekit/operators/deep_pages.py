"""Pages far into a table: rank selection instead of an offset."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tablekit.operators import view
from tablekit.plans.contract import Contract
from tablekit.plans.requests import Page, PageRequest, resolve_page

PIVOTS = 32
MOST_ROWS = 100_000
SEED = 11


@dataclass(frozen=True)
class Range:
    """Rows after the row ``low`` up to the row ``high``; None leaves a side open.

    ``skip`` rows of them come before the page and ``rows`` are in it, as far as known.
    """

    low: Mapping[str, Any] | None
    high: Mapping[str, Any] | None
    skip: int
    rows: int


def within(df: DataFrame, plan: list, place: Range) -> DataFrame:
    """The rows of a range. The leading value of either end goes to the scan as well."""
    if place.low is not None:
        df = df.where(view.leading_bound(df.schema, plan[0], place.low)).where(view.beyond(df.schema, plan, place.low))
    if place.high is not None:
        df = df.where(_leading_limit(df, plan, place.high)).where(~view.beyond(df.schema, plan, place.high))
    return df


def _leading_limit(df: DataFrame, plan: list, high: Mapping[str, Any]) -> Column:
    """What the first sort column satisfies in every row up to ``high``."""
    column, value = F.col(f"`{plan[0].column}`"), high[plan[0].column]
    if value is None:
        return F.lit(True) if plan[0].descending else column.isNull()
    literal = F.lit(value).cast(df.schema[plan[0].column].dataType)
    return column >= literal if plan[0].descending else (column <= literal) | column.isNull()


def page_range(df: DataFrame, page: Page, plan: list, most_rows: int = MOST_ROWS, pivots: int = PIVOTS) -> Range | None:
    """The range that holds a page and at most about ``most_rows`` rows; None past the end.

    A turn takes a few rows by chance as pivots and counts, in one scan, how many rows
    come after each. The pivots next to the page are the new ends. Only the pivots, and
    a number for each, come to the driver. Where rows are alike in all sort columns a
    range may not become smaller, and is taken as it is.
    """
    names = [F.col(f"`{sort.column}`") for sort in plan]
    rows = view.filtered(df, page).select(*names)
    first, last = page.index * page.size, (page.index + 1) * page.size
    place = Range(None, None, first, rows.count())
    if first >= place.rows:
        return None
    while place.rows > most_rows:
        held = within(rows, plan, place)
        drawn = held.orderBy(F.rand(SEED)).limit(pivots).distinct().orderBy(*map(view.ordering, plan)).collect()
        after = held.agg(
            *[F.count_if(view.beyond(rows.schema, plan, p.asDict())).alias(f"n{i}") for i, p in enumerate(drawn)]
        ).first()
        # Rows of the range up to and with each pivot.
        upto = [place.rows - after[i] for i in range(len(drawn))]
        page_end = place.skip + (last - first)
        low = max((i for i, n in enumerate(upto) if n <= place.skip), default=None)
        high = min((i for i, n in enumerate(upto) if n >= page_end), default=None)
        before = 0 if low is None else upto[low]
        end = place.rows if high is None else upto[high]
        if end - before == place.rows:
            break
        place = Range(
            place.low if low is None else drawn[low].asDict(),
            place.high if high is None else drawn[high].asDict(),
            place.skip - before,
            end - before,
        )
    return place


def deep_page_rows(
    df: DataFrame, page: Page, key: tuple[str, ...] = (), most_rows: int = MOST_ROWS, pivots: int = PIVOTS
) -> DataFrame:
    """Rows of one page, however deep: the same as ``view.page_rows``.

    An offset makes every task keep all rows before the page. Here counts find the range
    of the sort order that holds the page, and only the rows of that range are sorted.
    """
    plan = view.sort_plan(df.schema, page.sorts, key)
    place = page_range(df, page, plan, most_rows, pivots)
    if place is None:
        return df.limit(0)
    held = within(view.filtered(df, page), plan, place)
    return held.orderBy(*map(view.ordering, plan)).offset(place.skip).limit(page.size)


@dataclass(frozen=True)
class CountedPage:
    """A page's rows, held by the driver, and the number of rows its filters leave."""

    page: Page
    rows: DataFrame
    total: int


def page_with_total(df: DataFrame, contract: Contract, request: PageRequest) -> CountedPage:
    """A page and its total from one scan: rows are counted on their way to the sort.

    The page is taken at once, as its total is known only then.
    """
    page = resolve_page(request, contract.table, df.schema)
    seen = Observation()
    counted = view.filtered(df, page).observe(seen, F.count(F.lit(1)).alias("rows"))
    ordering = [view.ordering(sort) for sort in view.sort_plan(df.schema, page.sorts, contract.primary_key)]
    taken = counted.orderBy(*ordering).offset(page.index * page.size).limit(page.size).collect()
    return CountedPage(page, df.sparkSession.createDataFrame(taken, df.schema), seen.get["rows"])
