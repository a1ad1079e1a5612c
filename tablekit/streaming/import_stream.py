"""Incremental CSV import: files are taken in batches as they arrive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablekit.operators.ingest import check_rows, observed_writes
from tablekit.operators.key_index import BATCH, PARTS, KeyIndex
from tablekit.plans.contract import Contract
from tablekit.plans.naming import auto_map
from tablekit.sources.csv_files import (
    CORRUPT,
    POSITION,
    CsvLayout,
    csv_options,
    sniff_csv,
    text_schema,
    with_line,
    with_place,
)
from tablekit.sources.storage import Stage


METRICS = "successful_rows long, failed_rows long"


@dataclass(frozen=True)
class ImportFolders:
    """Where an import keeps its output; every batch owns one partition of each."""

    good: str
    rejects: str
    progress: str
    checkpoint: str
    keys: str

    @classmethod
    def under(cls, root: str) -> ImportFolders:
        return cls(f"{root}/good", f"{root}/rejects", f"{root}/progress", f"{root}/checkpoint", f"{root}/keys")


def import_stream(
    spark: SparkSession,
    source: str,
    contract: Contract,
    folders: ImportFolders,
    mapping: dict[str, str] | None = None,
    parents: Callable[[str], DataFrame] | None = None,
    target: DataFrame | None = None,
    files_per_batch: int | None = None,
    layout: CsvLayout | None = None,
    multi_line: bool = True,
    key_parts: int = PARTS,
) -> StreamingQuery:
    """Import all files now in ``source`` and stop; run again to take later files.

    A batch that is repeated after a failure overwrites its own partitions, so no
    row is written twice. Keys of earlier batches count as present; they are looked up in
    an index of keys, of which a batch reads the parts that its own keys fall in;
    ``key_parts`` is how many there are, the same for all runs of an import.
    """
    layout = layout or sniff_csv(spark, source)
    chosen = auto_map(layout.headers, contract.columns) if mapping is None else mapping
    reader = spark.readStream.options(**csv_options(layout, multi_line)).schema(text_schema(layout))
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = with_place(reader.csv(source), layout.headers)

    def owned(folder: str, number: int) -> Callable[[DataFrame], None]:
        return lambda df: df.write.mode("overwrite").parquet(f"{folder}/{BATCH}={number}")

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        index = KeyIndex(session, folders.keys, contract, key_parts)
        present = _present(index, number, target) if contract.primary_key else None
        raw = with_line(batch).select(*[F.col(f"`{h}`") for h in layout.headers], CORRUPT, *POSITION)
        with Stage() as stage:
            checked = check_rows(raw, contract, chosen, list(POSITION), parents, present, stage)
            counts = observed_writes(checked, owned(folders.good, number), owned(folders.rejects, number))
            owned(folders.progress, number)(session.createDataFrame([tuple(counts.values())], METRICS))
        if all(c in checked.columns for c in index.keys):
            good = session.read.schema(checked.good.schema).parquet(f"{folders.good}/{BATCH}={number}")
            index.add(good, number)

    return (
        lines.writeStream.foreachBatch(take)
        .option("checkpointLocation", folders.checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _present(
    index: KeyIndex, number: int, target: DataFrame | None
) -> Callable[[DataFrame, list[str]], DataFrame]:
    """Keys of the target, and those of earlier batches that may be among a batch's own."""

    def among(keys: DataFrame, names: list[str]) -> DataFrame:
        columns = [F.col(f"`{c}`") for c in index.keys]
        held = [] if target is None else [target.select(*columns)]
        earlier = index.among(keys, names, number)
        if earlier is not None:
            held.append(earlier)
        nothing = index.spark.createDataFrame([], index.contract.schema).select(*columns)
        return reduce(DataFrame.unionByName, held) if held else nothing

    return among


def imported(spark: SparkSession, folder: str) -> DataFrame:
    """Rows written so far, with the number of their batch in ``_batch``."""
    return spark.read.option("basePath", folder).parquet(folder)


def progress(spark: SparkSession, folders: ImportFolders) -> DataFrame:
    """Counts after each batch, as running totals of all batches up to it.

    There is one row per batch, few enough for the window's single task.
    """
    so_far = W.orderBy(BATCH).rowsBetween(W.unboundedPreceding, W.currentRow)
    return imported(spark, folders.progress).select(
        F.col(BATCH).cast("bigint").alias("batch"),
        F.sum("successful_rows").over(so_far).alias("successful_rows"),
        F.sum("failed_rows").over(so_far).alias("failed_rows"),
    )
