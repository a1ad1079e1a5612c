"""Changes of versioned tables that leave untouched files alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.operators import ingest, lookup, mutate
from tablekit.plans.contract import Contract
from tablekit.sources import storage
from tablekit.sources.versions import Version, Versions, shown_as

OUTCOME = "_outcome"
GOOD = "good"
REJECTED = "rejected"
CELL = "_cell_"


def create(
    versions: Versions, name: str, rows: DataFrame, cluster_by: list[str] | None = None, files: int | None = None
) -> Version:
    """Publish a table, by default as the rows come; ``cluster_by`` gives its files
    ranges of these columns, so that later changes touch few of them. ``files`` is about
    how many there are; without it, their number follows the size of the rows."""
    before = versions.version()
    if cluster_by:
        columns = [F.col(f"`{c}`") for c in cluster_by]
        rows = rows.repartitionByRange(*([files] if files else []), *columns)
    return versions.publish({name: versions.write(rows)}, {name: rows.schema}, before)


def _file() -> Column:
    """The file of a row, as versions name it: the folder below ``data`` and the name."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return F.concat_ws("/", F.lit("data"), F.element_at(parts, -2), F.element_at(parts, -1))


def touched_files(versions: Versions, name: str, patch: DataFrame, contract: Contract, version: Version) -> set[str]:
    """Files with a row whose key is in the patch, found from the key columns alone.

    The range of each key column in the patch goes to the scan, which skips the files
    and row groups outside of it. A small patch is broadcast after a check of its size.
    """
    keys = list(contract.primary_key)
    ends = patch.agg(
        *[F.min(f"key_{c}").alias(f"low_{c}") for c in keys], *[F.max(f"key_{c}").alias(f"high_{c}") for c in keys]
    ).first()
    rows = versions.table(name, version.number)
    for c in keys:
        rows = rows.where(F.col(f"`{c}`").between(F.lit(ends[f"low_{c}"]), F.lit(ends[f"high_{c}"])))
    held = rows.select(*[F.col(f"`{c}`") for c in keys], _file().alias("_file"))
    wanted = patch.select(*[F.col(f"key_{c}") for c in keys])
    if lookup.is_small(wanted):
        wanted = F.broadcast(wanted)
    met = held.join(wanted, mutate.key_match(held, wanted, contract), "left_semi")
    return {row["_file"] for row in met.select("_file").distinct().collect()}


def update_files(versions: Versions, name: str, patch: DataFrame, contract: Contract) -> Version:
    """Apply a patch to a versioned table; only files that hold a touched key are rewritten.

    The new version names the old files that are left and the new ones. A patch that
    meets no row publishes nothing.
    """
    before = versions.version()
    patch = storage.checkpointed(patch)
    touched = touched_files(versions, name, patch, contract, before)
    if not touched:
        return before
    paths = [f"{versions.root}/{path}" for path in sorted(touched)]
    rows = versions.spark.read.schema(versions.table(name, before.number).schema).parquet(*paths)
    fresh = versions.write(mutate.apply_updates(rows, patch, contract))
    kept = [path for path in before.files[name] if path not in touched]
    return versions.publish({name: [*kept, *fresh]}, {}, before)


def publish_import(checked: ingest.Checked, versions: Versions, name: str) -> tuple[Version, dict[str, int]]:
    """Write good rows and rejects in one pass and publish both at once, or neither.

    Good rows join the table ``name``, rejects ``<name>_rejects``: their original cells
    and the reason. The checked rows are worked out once and dealt by outcome. Returns
    the version and the counts of both, observed on the way.
    """
    before = versions.version()
    refused = F.col(ingest.REASON).isNotNull()
    counts = Observation()
    rows = checked.rows.select(
        F.when(refused, REJECTED).otherwise(GOOD).alias(OUTCOME),
        *[F.when(~refused, F.col(f"_out_{i}")).alias(c) for i, c in enumerate(checked.columns)],
        *[F.when(refused, F.col(f"_in_{i}")).alias(f"{CELL}{i}") for i in range(len(checked.headers))],
        ingest.REASON,
    ).observe(counts, F.count_if(F.col(OUTCOME) == GOOD).alias("good"), F.count(F.lit(1)).alias("all"))
    folder = versions.new_folder()
    rows.write.partitionBy(OUTCOME).parquet(f"{versions.root}/{folder}")
    seen = counts.get
    # Headers may read like columns of another type, so reject files number their cells.
    texts = [T.StructField(f"{CELL}{i}", T.StringType(), True, shown_as(h)) for i, h in enumerate(checked.headers)]
    rejected = T.StructType([*texts, T.StructField(ingest.REASON, T.StringType())])
    files, schemas = {}, {}
    for outcome, table, schema in ((GOOD, name, checked.good.schema), (REJECTED, f"{name}_rejects", rejected)):
        written = versions.files_of(f"{folder}/{OUTCOME}={outcome}")
        files[table] = [*before.files.get(table, ()), *written]
        schemas[table] = schema
    version = versions.publish(files, schemas, before)
    checked.stage.release()
    return version, {"successful_rows": seen["good"], "failed_rows": seen["all"] - seen["good"]}
