"""Shared folder for checkpoints and staged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor reaches, as named by the session.

    A session on one machine that names none stages in a folder of its warehouse; on a
    cluster that folder may be one of the driver alone, so there it is an error.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError(f"Set {CHECKPOINT_SETTING} to a folder that all executors reach.")
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_staged")
    return context.getCheckpointDir()


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark)}/tablekit-{purpose}-{uuid.uuid4().hex}"


class Stage:
    """Tables written once and read back, so that later jobs neither repeat the
    work above them nor see other row positions after a lost executor.

    As a context, the stage removes its tables when the block ends; results that
    read them have to be written by then. Otherwise they stay.
    """

    def __init__(self) -> None:
        self._folders: list[tuple[SparkSession, str]] = []

    def table(self, df: DataFrame, purpose: str) -> DataFrame:
        spark = df.sparkSession
        folder = new_folder(spark, purpose)
        self._folders.append((spark, folder))
        df.write.parquet(folder)
        return spark.read.schema(df.schema).parquet(folder)

    def release(self) -> None:
        while self._folders:
            spark, folder = self._folders.pop()
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
