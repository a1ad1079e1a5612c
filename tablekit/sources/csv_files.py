"""CSV files: sniffing, reading as text, exact writing."""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import rendering
from tablekit.plans.naming import unique_file_names
from tablekit.sources.catalog import Catalog

# The delimiters that are told apart.
COMMA = ","
SEMICOLON = ";"

CORRUPT = "_corrupt_line"
POSITION = ("_file", "_block", "_line")
TABLES_AT_ONCE = 4


@dataclass(frozen=True)
class CsvLayout:
    """Names by position. A blank name, or one repeated further on, is None there."""

    positions: list[str | None]
    delimiter: str
    carriage_returns: bool = False
    literal: bool = True  # the header holds the names exactly, so it can be checked

    @property
    def headers(self) -> list[str]:
        return [name for name in self.positions if name is not None]


def layout_of(first_line: str) -> CsvLayout:
    """Semicolons win only where they outnumber commas; names are trimmed."""
    returns = first_line.endswith("\r")
    line = first_line.strip()
    delimiter = SEMICOLON if line.count(SEMICOLON) > line.count(COMMA) else COMMA
    raw = next(csv.reader([line], delimiter=delimiter), [])
    names = [name.strip() for name in raw]
    positions = [
        name if name and name not in names[i + 1 :] else None for i, name in enumerate(names)
    ]
    return CsvLayout(positions, delimiter, returns, literal=positions == raw)


def sniff_csv(spark: SparkSession, path: str) -> CsvLayout:
    """Layout from the first line of one file; nothing else is read."""
    first = spark.read.text(path, lineSep="\n").where(F.length("value") > 0).first()
    return layout_of(first["value"] if first else "")


def text_schema(layout: CsvLayout) -> T.StructType:
    names = [name or f"_unnamed_{i}" for i, name in enumerate(layout.positions)]
    fields = [T.StructField(name, T.StringType()) for name in names]
    return T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])


def csv_options(layout: CsvLayout, multi_line: bool = True) -> dict[str, str]:
    options = {
        "sep": layout.delimiter,
        "quote": '"',
        "escape": '"',
        "emptyValue": "",
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        "header": "true",
        "enforceSchema": str(not layout.literal).lower(),
        "multiLine": str(multi_line).lower(),
    }
    if not layout.carriage_returns:
        options["lineSep"] = "\n"  # keeps carriage returns inside quoted cells
    return options


def read_csv_text(
    spark: SparkSession, path: str, layout: CsvLayout | None = None, multi_line: bool = True
) -> DataFrame:
    """Every cell as text, the raw line of ragged rows, and the place in the input.

    Quoted cells may hold line breaks with ``multi_line``, which is one task for each
    file; ``multi_line=False`` is for files without such breaks and splits them
    anywhere. Both read a file of single lines alike.
    """
    layout = layout or sniff_csv(spark, path)
    if not layout.headers:
        raise ValueError(f"No CSV header in {path}")
    reader = spark.read.options(**csv_options(layout, multi_line)).schema(text_schema(layout))
    return with_line(with_place(reader.csv(path), layout.headers))


def _cells(headers: list[str]) -> list[Column]:
    """Empty cells as empty text; ragged rows keep what could be read of them."""
    whole = F.col(CORRUPT).isNull()
    return [
        F.when(whole, F.coalesce(F.col(f"`{h}`"), F.lit(""))).otherwise(F.col(f"`{h}`")).alias(h)
        for h in headers
    ]


def with_place(raw: DataFrame, headers: list[str]) -> DataFrame:
    """Cells, and the file part every row comes from."""
    file, block, _ = POSITION
    return raw.select(
        *_cells(headers),
        CORRUPT,
        F.col("_metadata.file_path").alias(file),
        F.col("_metadata.file_block_start").alias(block),
    )


def with_line(placed: DataFrame) -> DataFrame:
    """A number that grows along each file part; unique over all rows."""
    return placed.withColumn(POSITION[-1], F.monotonically_increasing_id())


def csv_texts(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            rendering.text_of(F.col(f"`{f.name}`"), f.dataType).alias(f.name)
            for f in df.schema.fields
        ]
    )


def csv_lines(df: DataFrame, *keep: str) -> DataFrame:
    """One CSV record per row in ``line``; ``keep`` names columns to carry along."""
    cells = [rendering.csv_cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return df.select(*keep, F.concat_ws(COMMA, *cells).alias("line"))


def write_csv(df: DataFrame, path: str, delimiter: str = COMMA) -> None:
    """Every cell quoted, null as the empty cell, a header in every part file."""
    csv_texts(df).na.fill("").write.csv(
        path,
        header=True,
        sep=delimiter,
        quoteAll=True,
        quote='"',
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        lineSep="\n",
    )


def write_database(catalog: Catalog, out: str, at_once: int = TABLES_AT_ONCE) -> dict[str, str]:
    """One CSV folder per table under ``out``; returns table -> folder.

    Writes don't depend on each other, so several run side by side.
    """
    folders = dict(zip(catalog.names, unique_file_names(catalog.names, ".csv"), strict=True))
    with ThreadPoolExecutor(at_once) as pool:
        jobs = [pool.submit(write_csv, catalog.table(n), f"{out}/{f}") for n, f in folders.items()]
        for job in jobs:
            job.result()
    return folders
