"""INSERT dumps on disk."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import rendering, sql_scan
from tablekit.operators.dump import MISFITS, insert_heads, typed_cells


def statements(
    spark: SparkSession, path: str, table: str, columns: list[str], dialect: str, backslashes: bool = False
) -> DataFrame:
    """The ``values`` of each INSERT into a table: its text behind the head.

    A literal may hold line breaks, and text that reads like a statement. So whether a
    line begins inside a literal is told from the number of quotes before it: those of
    earlier blocks of its file, of which there is one row each, and those of earlier
    lines of its block. A block of lines is shuffled once; what then moves again are the
    statements that stand in two blocks or more. Comments in the dump are passed over; they
    may not hold an odd number of single quotes, as nothing tells them from literals.
    """
    heads = insert_heads(table, columns, dialect)
    if any(sql_scan.QUOTE in head for head in heads):
        raise ValueError("Names with a single quote can't be told from literals.")
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
        sql_scan.sheltered(F.col("value"), backslashes).alias("_text"),
    )
    lines = lines.withColumn("_quotes", sql_scan.quotes(F.col("_text")))
    in_file = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    # Parities are all that matters, and a bit for each block is all that is summed.
    blocks = lines.groupBy("_file", "_block").agg((F.sum("_quotes") % 2).alias("_odd"))
    blocks = blocks.select("_file", "_block", F.coalesce(F.sum("_odd").over(in_file), F.lit(0)).alias("_before"))

    in_block = W.partitionBy("_file", "_block").orderBy("_line")
    earlier = F.coalesce(F.sum("_quotes").over(in_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = lines.join(blocks, ["_file", "_block"]).withColumn("_outside", (earlier + F.col("_before")) % 2 == 0)
    begins = reduce(lambda a, b: a | b, [F.upper(F.ltrim(F.substring("_text", 1, len(h) + 8))).startswith(h.upper()) for h in heads])
    opens = F.col("_outside") & begins
    # Other statements outside of literals end the one before.
    other = F.col("_outside") & ~begins & F.col("_text").rlike(r"^\s*(?i)(INSERT|CREATE|DROP|ALTER|LOCK|UNLOCK|SET|BEGIN|COMMIT|PRAGMA|--|/\*)")
    after = (F.col("_before") + earlier + F.col("_quotes")) % 2 == 0
    marked = placed.withColumns(
        {"_opens": opens, "_other": other, "_ends": after & F.col("_text").rlike(r"\)\s*;\s*$")}
    )
    fresh = F.col("_opens") | F.col("_other") | F.coalesce(F.lag("_ends").over(in_block), F.lit(False))
    numbered = marked.withColumn("_fresh", fresh).withColumn("_number", F.count_if("_fresh").over(in_block))
    pieces = numbered.groupBy("_file", "_block", "_number").agg(
        F.sort_array(F.collect_list(F.struct("_line", "_text"))).alias("_lines"),
        F.bool_or("_opens").alias("_opened"),
        F.bool_or("_ends").alias("_ended"),
    )
    pieces = pieces.withColumn("_joined", F.array_join(F.col("_lines")["_text"], "\n")).drop("_lines")
    whole = pieces.where(F.col("_opened") & F.col("_ended")).select("_joined")

    # What a block leaves open goes on in the first pieces of later blocks, up to an end.
    rest = pieces.where((F.col("_opened") | (F.col("_number") == 0)) & ~(F.col("_opened") & F.col("_ended")))
    group = F.count_if("_opened").over(W.partitionBy("_file").orderBy("_block", "_number"))
    parts = rest.withColumn("_group", group).groupBy("_file", "_group").agg(
        F.sort_array(F.collect_list(F.struct("_block", "_number", "_ended", "_joined"))).alias("_pieces"),
    )
    ended = F.array_position(F.col("_pieces")["_ended"], True)
    size = F.when(ended > 0, ended).otherwise(F.size("_pieces")).cast("int")
    texts = F.slice(F.col("_pieces")["_joined"], F.lit(1), size)
    joined = parts.where("_group > 0").select(F.array_join(texts, "\n").alias("_joined"))
    found = whole.unionByName(joined)
    values = F.regexp_replace(F.col("_joined"), r"(?is)^\s*INSERT\s+INTO\s+[^']*?\bVALUES\s*(?=\()", "")
    return found.select(values.alias("values"))


def read_insert_text(
    spark: SparkSession,
    path: str,
    table: str,
    schema: T.StructType,
    dialect: str,
    columns: list[str] | None = None,
    backslashes: bool = False,
    misfits: bool = False,
) -> DataFrame:
    """Rows of INSERT dumps; inverse of ``dump.insert_statements``.

    ``columns`` names the order of the cells, by default that of the schema; with
    ``backslashes``, literals hold backslash escapes. ``misfits`` adds a column with the
    names of those columns whose cell doesn't fit, as null there; a tuple of another
    number of cells fits no column.
    """
    if dialect not in rendering.DIALECTS:
        raise ValueError(f"Unknown dialect: {dialect}")
    order = columns or list(schema.names)
    if sorted(order) != sorted(schema.names):
        raise ValueError("The dump's columns are not those of the schema.")
    found = statements(spark, path, table, order, dialect, backslashes)
    cells = found.select(F.explode(sql_scan.tuples(F.col("values"))).alias("cells"))

    def text(i: int, _: T.DataType) -> Column:
        return sql_scan.cell_text(F.get(F.col("cells"), F.lit(i)), backslashes)

    rows = typed_cells(cells, T.StructType([schema[c] for c in order]), text)
    return rows.select(*[F.col(f"`{c}`") for c in schema.names], *([MISFITS] if misfits else []))
