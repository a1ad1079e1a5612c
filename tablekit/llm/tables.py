"""Tables of the operators: reading, document keys, staging."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A worker takes in a batch whole, and the executor holds it up to three times while it is
# sent, so batches are cut by their bytes; a longer row is a batch of its own.
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_LIMIT_DEFAULT = str(64 << 20)
BATCH_LIMIT_LEAN = str(4 << 20)

# A null document id sorts before every other and stands as this number inside.
NULL_ID = -(2**63)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lean(spark: SparkSession) -> SparkSession:
    """Batches of texts sent to Python workers kept small, unless the session has chosen their size."""
    if spark.conf.get(BATCH_LIMIT, BATCH_LIMIT_DEFAULT).removesuffix("b") == BATCH_LIMIT_DEFAULT:
        spark.conf.set(BATCH_LIMIT, BATCH_LIMIT_LEAN)
    return spark


def keyed(docs: DataFrame) -> DataFrame:
    """``doc`` and ``text`` without nulls, whatever else the table holds."""
    lean(docs.sparkSession)
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc"),
        F.coalesce(docs["text"], F.lit("")).alias("text"),
    )


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct, whatever characters their names have."""
    return F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns])


def doc_id(column: str = "doc") -> Column:
    """The id as the table has it."""
    return F.when(F.col(column) != NULL_ID, F.col(column)).alias("doc_id")


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach; only a session that names none gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return context.getCheckpointDir()


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a written table, so that later jobs don't repeat the work above."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    _FOLDERS[id(out)] = (out, folder)
    return out


# Staged tables that may still be dropped, each with its folder.
_FOLDERS: dict[int, tuple[DataFrame, str]] = {}


def dropped(*tables: DataFrame | None) -> None:
    """Deletes staged tables that nothing will read again."""
    for df in tables:
        held = _FOLDERS.pop(id(df), None)
        if held is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(held[1])
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def staged_counting(df: DataFrame, purpose: str, **counts: Column) -> tuple[DataFrame, dict]:
    """The rows as a written table, and aggregates of them seen while they were written."""
    seen = Observation()
    out = staged(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), purpose)
    return out, seen.get
