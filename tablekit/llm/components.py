"""Connected components of a graph that no single machine could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablekit.llm import tables


def components(edges: DataFrame) -> DataFrame:
    """``doc`` and ``component``, its smallest reachable document, of all ends of edges.

    Every node points to the smallest node it knows. A round joins pointers along the
    edges, takes the smallest, and then follows pointers once more, so that chains halve.
    Each round is written and read again; rounds end when no pointer moves. The minima are partial
    before every shuffle, so a node with many edges is a row per task.
    """
    both = tables.staged(
        edges.select(F.col("a").alias("doc"), F.col("b").alias("other"))
        .unionByName(edges.select(F.col("b").alias("doc"), F.col("a").alias("other")))
        .distinct(),
        "edges",
    )
    points = both.groupBy("doc").agg(F.min("other").alias("other"))
    points = tables.staged(points.select("doc", F.least("doc", "other").alias("component")), "points")
    while True:
        far = points.select(F.col("doc").alias("other"), F.col("component").alias("near"))
        offered = both.join(far, "other").groupBy("doc").agg(F.min("near").alias("near"))
        lower = points.join(offered, "doc", "left").select(
            "doc", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("old")
        )
        jump = points.select(F.col("doc").alias("component"), F.col("component").alias("further"))
        moved = lower.join(jump, "component", "left").select(
            "doc", F.least("component", F.coalesce("further", "component")).alias("component"), "old"
        )
        moves = F.count_if(F.col("component") != F.col("old"))
        before, (points, seen) = points, tables.staged_counting(moved, "points", moves=moves)
        tables.dropped(before)
        if not seen["moves"]:
            tables.dropped(both)
            return points
