"""COPY text on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import rendering
from tablekit.operators import lookup
from tablekit.operators.dump import copy_header, copy_rows
from tablekit.sources import storage


def read_copy_text(
    spark: SparkSession, path: str, table: str, schema: T.StructType, misfits: bool = False
) -> DataFrame:
    """Rows of COPY data files, with or without their header and end lines.

    Only the first line of a file can be its header; a data line that reads like it is
    data. No data line can equal the end line, because data doubles its backslashes.
    ``misfits`` adds the names of columns whose cell doesn't fit, as ``dump.copy_rows`` does.
    """
    header = copy_header(table, list(schema.names))
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    # Line numbers grow along a block and are the same in every scan of the files. One scan
    # finds the first line of each file, and the numbers of those that are headers.
    number = F.when(F.col("_block") == 0, F.col("_line"))
    firsts = lines.groupBy("_file").agg(
        F.min(number).alias("_line"), F.min(F.when((F.col("_block") == 0) & (F.col("line") == header), F.col("_line"))).alias("_top")
    )
    # A row for each file whose first line reads like the header.
    headers = storage.checkpointed(firsts.where("_line = _top").select("_line"))
    if lookup.is_small(headers):
        headers = F.broadcast(headers)
    data = lines.where(F.col("line") != rendering.COPY_END).join(headers, "_line", "left_anti")
    return copy_rows(data.select("line"), schema, misfits)
