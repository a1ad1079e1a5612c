"""Keys that are in use, kept so that a lookup reads only the parts it needs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.plans.contract import Contract
from tablekit.sources import storage

BATCH = "_batch"
PART = "_part"
PARTS = 1024


@dataclass(frozen=True)
class KeyIndex:
    """The keys of every batch so far, in a folder for each batch, sorted by hash of the key.

    Only key columns are kept, and the part of the hash's range that a key falls in. Files
    and their row groups hold few parts each, so a scan for some parts skips the others. A batch that is repeated overwrites its own keys, and a
    lookup on behalf of a batch sees those of earlier batches only, so a replay decides
    as the first try did. ``parts`` must stay the same for the life of an index.
    """

    spark: SparkSession
    folder: str
    contract: Contract
    parts: int = PARTS

    @property
    def keys(self) -> list[str]:
        return list(self.contract.primary_key)

    def _schema(self) -> T.StructType:
        fields = [self.contract.schema[c] for c in self.keys]
        return T.StructType([*fields, T.StructField(PART, T.IntegerType()), T.StructField(BATCH, T.IntegerType())])

    def _part(self, names: list[str]) -> Column:
        # Cast to the table's types, so that a key falls in one part whatever it is read from.
        typed = [F.col(f"`{n}`").cast(self.contract.schema[c].dataType) for n, c in zip(names, self.keys, strict=True)]
        return F.pmod(F.xxhash64(*typed), F.lit(self.parts)).cast("int")

    def add(self, rows: DataFrame, batch: int) -> None:
        """The keys of a batch, in order of their parts."""
        keys = rows.select(*[F.col(f"`{c}`") for c in self.keys]).withColumn(PART, self._part(self.keys))
        placed = keys.repartitionByRange(PART).sortWithinPartitions(PART)
        placed.write.mode("overwrite").parquet(f"{self.folder}/{BATCH}={batch}")

    def before(self, batch: int) -> DataFrame | None:
        """All keys of earlier batches; none where there is no earlier batch."""
        if batch <= 0 or not storage.exists(self.spark, self.folder):
            return None
        held = self.spark.read.schema(self._schema()).option("basePath", self.folder).parquet(self.folder)
        return held.where(F.col(BATCH) < batch)

    def among(self, keys: DataFrame, names: list[str], batch: int) -> DataFrame | None:
        """Keys of earlier batches from the parts that ``keys`` (columns ``names``) fall in.

        The parts wanted are at most ``parts`` numbers.
        """
        held = self.before(batch)
        if held is None:
            return None
        wanted = [row[PART] for row in keys.select(self._part(names).alias(PART)).distinct().collect()]
        return held.where(F.col(PART).isin(wanted)).select(*[F.col(f"`{c}`") for c in self.keys])
