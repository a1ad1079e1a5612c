"""Chart points: a measure grouped by a dimension or a time bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import kinds, parsing, rendering
from tablekit.plans.requests import Chart, ChartRequest, resolve_chart

AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def chart_groups(df: DataFrame, chart: Chart) -> DataFrame:
    """``bucket`` and ``value`` of the first ``limit + 1`` groups.

    The extra group tells whether anything was left out, without a second count.
    """
    bucket = F.col(f"`{chart.bucket}`")
    metric = F.lit(1) if chart.metric is None else F.col(f"`{chart.metric}`")
    if chart.grain is not None:
        bucket = F.date_trunc(chart.grain, bucket)
    grouped = df.groupBy(bucket.alias("bucket")).agg(
        AGGREGATES[chart.aggregation](metric).alias("value")
    )
    by_bucket = F.col("bucket").asc_nulls_first()
    order = [by_bucket] if chart.grain else [F.col("value").desc_nulls_last(), by_bucket]
    return grouped.orderBy(*order).limit(chart.limit + 1)


def _label(bucket: Column, data_type: T.DataType, grain: str | None) -> Column:
    text = rendering.bucket_text(bucket, grain) if grain else rendering.text_of(bucket, data_type)
    return rendering.chart_label(text)


def chart_points(df: DataFrame, chart: Chart) -> DataFrame:
    """Points in drawing order: ``position, x, y, truncated``.

    Groups without a finite measure are dropped after the cut at ``limit + 1``
    groups, so the extra group can fill a gap. The windows see the cut groups only.
    """
    groups = chart_groups(df, chart)
    types = {field.name: field.dataType for field in groups.schema.fields}
    by_bucket = F.col("bucket").asc_nulls_first()
    order = [by_bucket] if chart.grain else [F.col("value").desc_nulls_last(), by_bucket]
    everything = W.partitionBy(F.lit(0))
    measured = groups.select(
        F.row_number().over(everything.orderBy(*order)).alias("rank"),
        F.count(F.lit(1)).over(everything).alias("fetched"),
        _label(F.col("bucket"), types["bucket"], chart.grain).alias("x"),
        parsing.metric_number(F.col("value"), types["value"]).alias("y"),
    ).where(F.col("y").isNotNull())
    return (
        measured.withColumn("position", F.row_number().over(everything.orderBy("rank")))
        .where(F.col("position") <= chart.limit)
        .select("position", "x", "y", (F.col("fetched") > chart.limit).alias("truncated"))
    )


def chart(df: DataFrame, table: str, request: ChartRequest) -> DataFrame:
    """Points of a chart request; a request that makes no sense raises first."""
    return chart_points(df, resolve_chart(request, table, df.schema))
