"""Table pages: filters, sorts, one page of rows and the filtered total."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import kinds, parsing, rendering
from tablekit.plans.contract import Contract
from tablekit.plans.requests import Filter, Page, PageRequest, Sort, resolve_page


def _number_filter(column: Column, field: T.StructField, text: str) -> Column:
    """Equality with a literal of the column's own type, so the scan can use it."""
    number = parsing.number_from_text(text)
    if number is None:
        raise ValueError(f"Filter value for {field.name} must be numeric.")
    if isinstance(field.dataType, kinds.FRACTIONAL_TYPES):
        try:
            return column == F.lit(float(number)).cast(field.dataType)
        except OverflowError:  # beyond every double
            return F.lit(False)
    if isinstance(field.dataType, T.DecimalType):
        whole_digits = field.dataType.precision - field.dataType.scale
        exact = Decimal(text.strip()) if isinstance(number, float) else Decimal(number)
        if not exact.is_finite():
            return F.lit(False)
        digits, places = exact.as_tuple().digits, -exact.as_tuple().exponent
        rest = digits[len(digits) - max(places - field.dataType.scale, 0) :]
        fits = not any(rest) and abs(exact) < 10**whole_digits
        return column == F.lit(str(exact)).cast(field.dataType) if fits else F.lit(False)
    bits = parsing.INTEGER_BITS[type(field.dataType)]
    if number != int(number) or not -(2 ** (bits - 1)) <= number < 2 ** (bits - 1):
        return F.lit(False)
    return column == F.lit(int(number)).cast(field.dataType)


def _text_filter(column: Column, text: str) -> Column:
    """Case-blind containment; ``%`` and ``_`` typed by the user stay wildcards."""
    escape = next(c for c in map(chr, range(1, 32)) if c not in text)
    pattern = F.lit(f"%{text.lower()}%")
    return F.like(F.lower(column.cast("string")), pattern, F.lit(escape))


def filter_condition(schema: T.StructType, filters: tuple[Filter, ...]) -> Column | None:
    conditions = []
    for item in filters:
        field = schema[item.column]
        column = F.col(f"`{item.column}`")
        kind = kinds.kind_of(field.dataType)
        if kind == kinds.NUMERIC:
            conditions.append(_number_filter(column, field, item.value))
        elif kind == kinds.BOOLEAN:
            wanted = parsing.boolean_from_text(item.value)
            if wanted is None:
                raise ValueError(f"Filter value for {item.column} must be a boolean.")
            conditions.append(column == F.lit(wanted))
        elif isinstance(field.dataType, kinds.NESTED_TYPES):
            conditions.append(_text_filter(rendering.json_text(column, field.dataType), item.value))
        else:
            conditions.append(_text_filter(column, item.value))
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def sort_plan(schema: T.StructType, sorts: tuple[Sort, ...], key: tuple[str, ...]) -> list[Sort]:
    """Requested sorts, or the first column, then the key or all other columns so
    that no two pages overlap."""
    plan = list(sorts) or [Sort(schema.names[0])]
    sortable = [f.name for f in schema.fields if kinds.is_orderable(f.dataType)]
    used = {sort.column for sort in plan}
    plan += [Sort(name) for name in (key or sortable) if name not in used]
    return [sort for sort in plan if sort.column in sortable]


def ordering(sort: Sort) -> Column:
    column = F.col(f"`{sort.column}`")
    return column.desc_nulls_last() if sort.descending else column.asc_nulls_first()


def filtered(df: DataFrame, page: Page) -> DataFrame:
    condition = filter_condition(df.schema, page.filters)
    return df if condition is None else df.where(condition)


def page_rows(df: DataFrame, page: Page, key: tuple[str, ...] = ()) -> DataFrame:
    """Rows of one page; each task keeps only the first ``offset + size`` rows."""
    order = [ordering(sort) for sort in sort_plan(df.schema, page.sorts, key)]
    return filtered(df, page).orderBy(*order).offset(page.index * page.size).limit(page.size)


def page_rows_after(
    df: DataFrame, page: Page, last: Mapping[str, Any], key: tuple[str, ...] = ()
) -> DataFrame:
    """Rows that follow the row ``last`` in the order of the page.

    The cost does not grow with the depth of the page, unlike an offset: no task
    keeps more than a page, and the scan can skip what lies before the leading
    value of the order.
    """
    plan = sort_plan(df.schema, page.sorts, key)
    bound = leading_bound(df.schema, plan[0], last)
    rest = filtered(df, page).where(bound).where(beyond(df.schema, plan, last))
    return rest.orderBy(*map(ordering, plan)).limit(page.size)


def beyond(schema: T.StructType, plan: list[Sort], last: Mapping[str, Any]) -> Column:
    """Whether a row follows the row ``last`` in the order of the plan; never null."""
    follows = F.lit(False)
    equal = F.lit(True)
    for sort in plan:
        column = F.col(f"`{sort.column}`")
        value = F.lit(last[sort.column]).cast(schema[sort.column].dataType)
        if last[sort.column] is None:
            after = F.lit(False) if sort.descending else column.isNotNull()
        elif sort.descending:
            after = (column < value) | column.isNull()
        else:
            after = column > value
        follows = follows | (equal & F.coalesce(after, F.lit(False)))
        equal = equal & column.eqNullSafe(value)
    return follows


def leading_bound(schema: T.StructType, sort: Sort, last: Mapping[str, Any]) -> Column:
    """What the first sort column must satisfy in every later row."""
    column, value = F.col(f"`{sort.column}`"), last[sort.column]
    if value is None:
        return column.isNull() if sort.descending else F.lit(True)
    literal = F.lit(value).cast(schema[sort.column].dataType)
    return (column <= literal) | column.isNull() if sort.descending else column >= literal


def page_total(df: DataFrame, page: Page) -> DataFrame:
    """One row: filtered total, page number, page size and number of pages."""
    counted = filtered(df, page).agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(rendering.whole_count(F.col("n")), F.lit(0).cast("bigint"))
    return counted.select(
        total.alias("total_rows"),
        F.lit(page.index).cast("bigint").alias("page_index"),
        F.lit(page.size).cast("bigint").alias("page_size"),
        F.ceil(total / F.lit(page.size)).cast("bigint").alias("page_count"),
    )


@dataclass(frozen=True)
class TablePage:
    page: Page
    rows: DataFrame
    total: DataFrame


def table_page(df: DataFrame, contract: Contract, request: PageRequest) -> TablePage:
    """Rows and total of a page; one far into the table is found by counting, not by an offset."""
    from tablekit.operators import deep_pages

    page = resolve_page(request, contract.table, df.schema)
    rows_of = deep_pages.deep_page_rows if page.index * page.size > deep_pages.MOST_ROWS else page_rows
    return TablePage(page, rows_of(df, page, contract.primary_key), page_total(df, page))


def row_identity(key: tuple[str, ...]) -> Column:
    """JSON of the key columns, null ones left out."""
    return F.to_json(F.struct(*[F.col(f"`{name}`") for name in key]))


def row_key(schema: T.StructType, key: tuple[str, ...]) -> Column:
    """``pk:`` and the key where it has a value, else ``row:`` and all columns by name."""
    whole_row = F.concat(
        F.lit("row:"),
        F.to_json(
            F.struct(*[F.col(f"`{name}`") for name in sorted(schema.names)]),
            {"ignoreNullFields": "false", "timestampNTZFormat": rendering.ISO_TIMESTAMP,
             "timestampFormat": rendering.ISO_TIMESTAMP},
        ),
    )
    if not key:
        return whole_row
    by_key = F.concat(F.lit("pk:"), row_identity(tuple(sorted(key))))
    has_key = reduce(lambda a, b: a | b, [F.col(f"`{name}`").isNotNull() for name in key])
    return F.when(has_key, by_key).otherwise(whole_row)
