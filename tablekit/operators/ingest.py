"""Mapped import of text records: typed good rows, and rejects with a reason."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import kinds, parsing
from tablekit.operators import lookup
from tablekit.plans.contract import Contract
from tablekit.plans.naming import auto_map, effective_mapping
from tablekit.sources import storage
from tablekit.sources.csv_files import (
    CORRUPT,
    POSITION,
    csv_lines,
    read_csv_text,
    sniff_csv,
    write_csv,
)

REASON = "_error_reason"

# Rows that have the key columns, or a function from keys and the names of their
# columns to such rows, all that match among them.
Target = DataFrame | Callable[[DataFrame, list[str]], DataFrame]

# The reasons given for a rejected row, in order of precedence.
RAGGED = "Row has a wrong number of fields."
WRONG_TYPE = "Invalid {type} value in column {column}."
MISSING = "Missing value in required column {column}."
NOT_ALLOWED = "Value not allowed in column {column}."
UNKNOWN_REFERENCE = "Column {column} refers to no row of {reference}."
DUPLICATE = "Duplicate key ({key})."


@dataclass(frozen=True)
class Checked:
    """Checked rows: input cells as ``_in_<i>``, typed values as ``_out_<i>``."""

    rows: DataFrame
    headers: list[str]
    columns: list[str]
    stage: storage.Stage

    @property
    def good(self) -> DataFrame:
        accepted = self.rows.where(F.col(REASON).isNull())
        return accepted.select(*[F.col(f"_out_{i}").alias(c) for i, c in enumerate(self.columns)])

    @property
    def rejects(self) -> DataFrame:
        """Original fields and the reason."""
        refused = self.rows.where(F.col(REASON).isNotNull())
        return refused.select(
            *[F.col(f"_in_{i}").alias(h) for i, h in enumerate(self.headers)], REASON
        )

    @property
    def metrics(self) -> DataFrame:
        """One row: accepted and rejected rows."""
        return self.rows.agg(
            F.count_if(F.col(REASON).isNull()).alias("successful_rows"),
            F.count_if(F.col(REASON).isNotNull()).alias("failed_rows"),
        )


def map_columns(raw: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Mapped cells under their column names; rows in which nothing is mapped are skipped."""
    chosen = effective_mapping(mapping)
    rows = raw if chosen else raw.where(F.lit(False))
    return rows.select(*[F.col(f"`{header}`").alias(column) for column, header in chosen.items()])


def _first_error(conditions: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(when, F.lit(text)) for when, text in conditions], F.lit(None).cast("string"))


def _local_checks(
    raw: DataFrame, contract: Contract, mapping: dict[str, str], headers: list[str], position: list[str]
) -> tuple[DataFrame, list[str]]:
    """All checks that need one row only: field count, types, presence, allowed values."""
    sources = effective_mapping(mapping)
    unknown = sorted(set(sources) - set(contract.columns)) + sorted(set(sources.values()) - set(headers))
    if unknown:
        raise ValueError(f"Mapping names unknown columns: {', '.join(unknown)}")
    columns = [c for c in contract.columns if c in sources]
    if not columns:
        raw = raw.where(F.lit(False))  # rows in which nothing is mapped are skipped
    types_of = {c: contract.schema[c].dataType for c in columns}
    bodies = raw.select(
        *[F.col(f"`{h}`").alias(f"_in_{i}") for i, h in enumerate(headers)],
        *[
            parsing.body_of(F.col(f"`{sources[c]}`"), types_of[c]).alias(f"_body_{i}")
            for i, c in enumerate(columns)
        ],
        *position,
        (F.col(CORRUPT).isNotNull() if CORRUPT in raw.columns else F.lit(False)).alias("_ragged"),
    )
    typed = bodies.select(
        *[f"_in_{i}" for i, _ in enumerate(headers)],
        *[
            parsing.typed_value(F.col(f"_body_{i}"), types_of[c]).alias(f"_out_{i}")
            for i, c in enumerate(columns)
        ],
        *position,
        "_ragged",
    )
    number = {h: i for i, h in enumerate(headers)}
    types, missing, domains = [], [], []
    for i, column in enumerate(columns):
        text, value = F.col(f"_in_{number[sources[column]]}"), F.col(f"_out_{i}")
        data_type = types_of[column]
        if not isinstance(data_type, T.StringType):
            types.append(
                (
                    text.isNotNull() & value.isNull(),
                    WRONG_TYPE.format(type=data_type.simpleString(), column=column),
                )
            )
        if column in contract.must_have_value:
            missing.append((value.isNull(), MISSING.format(column=column)))
        if column in contract.enums:
            allowed = contract.enums[column]
            domains.append((~value.isin(*allowed), NOT_ALLOWED.format(column=column)))
    absent = [
        (F.lit(True), MISSING.format(column=c))
        for c in contract.columns
        if c in contract.must_have_value and c not in columns and c not in contract.auto_increment
    ]
    reason = _first_error([(F.col("_ragged"), RAGGED), *types, *missing, *absent, *domains])
    return typed.withColumn(REASON, reason).drop("_ragged"), columns


def _plain_texts(
    contract: Contract, mapping: dict[str, str], headers: list[str], columns: list[str]
) -> dict[str, Column]:
    """For input cells, the usual text of the value read from them. A cell that has this text
    need not be written beside the value."""
    sources, texts = effective_mapping(mapping), {}
    for i, column in enumerate(columns):
        value, kind = F.col(f"_out_{i}"), contract.schema[column].dataType
        if isinstance(kind, (T.StringType, *kinds.INTEGRAL_TYPES)):
            texts[f"_in_{headers.index(sources[column])}"] = value.cast("string")
    return texts


def check_rows(
    raw: DataFrame,
    contract: Contract,
    mapping: dict[str, str],
    position: list[str],
    parents: Callable[[str], DataFrame] | None = None,
    target: Target | None = None,
    stage: storage.Stage | None = None,
) -> Checked:
    """Check text rows against a contract, without failing on any of them.

    ``position`` names columns that give every row its place in the input. A row
    refused for another reason does not occupy its key. The typed rows are staged,
    so the later passes read only the columns they need. ``target`` holds keys in use,
    or gives those that may match some keys.
    """
    stage = stage or storage.Stage()
    headers = [c for c in raw.columns if c not in (*position, CORRUPT)]
    rows, columns = _local_checks(raw, contract, mapping, headers, position)
    plain = _plain_texts(contract, mapping, headers, columns)
    rows = stage.table(rows.withColumns({c: F.nullif(F.col(c), text) for c, text in plain.items()}), "import")
    rows = rows.withColumns({c: F.coalesce(c, text) for c, text in plain.items()})
    out = {c: f"_out_{i}" for i, c in enumerate(columns)}
    keep = lookup.staged_in(stage, "keys")
    rows = _check_references(rows, contract, out, parents, keep)
    rows = _check_keys(rows, contract, out, position, target, keep)
    return Checked(rows, headers, columns, stage)


def _check_references(
    rows: DataFrame,
    contract: Contract,
    out: dict[str, str],
    parents: Callable[[str], DataFrame] | None,
    keep: lookup.Keep,
) -> DataFrame:
    accepted = rows.where(F.col(REASON).isNull())
    for key in contract.foreign_keys:
        if parents is None or key.column not in out:
            continue
        column = out[key.column]
        values, few = keep(lookup.key_counts(accepted.select(column), [column]))
        marked = lookup.held_marked(values, [column], parents(key.ref_table), [key.ref_column], few)
        missing = marked.where(~F.col("_held")).select(column, "_n")
        message = UNKNOWN_REFERENCE.format(
            column=key.column, reference=f"{key.ref_table}.{key.ref_column}"
        )
        rows = (
            lookup.attach(rows, missing, [column], keep=keep)
            .withColumn(REASON, F.coalesce(REASON, F.when(F.col("_n").isNotNull(), message)))
            .drop("_n")
        )
    return rows


def _check_keys(
    rows: DataFrame,
    contract: Contract,
    out: dict[str, str],
    position: list[str],
    target: Target | None,
    keep: lookup.Keep,
) -> DataFrame:
    """The first row of a key stays, unless the target holds the key already.

    All keys are counted, but places are compared for repeated keys only: the first of
    several columns makes a grouping sort its rows.
    """
    if not contract.primary_key or any(c not in out for c in contract.primary_key):
        return rows
    keys = [out[c] for c in contract.primary_key]
    place = F.struct(*[F.col(p) for p in position])
    accepted = rows.where(F.col(REASON).isNull()).select(*keys, *position)
    groups = lookup.key_counts(accepted.select(*keys), keys)
    if target is None:
        groups = groups.withColumn("_held", F.lit(False))
    else:
        groups, few = keep(groups)
        held = target if isinstance(target, DataFrame) else target(groups, keys)
        groups = lookup.held_marked(groups, keys, held, list(contract.primary_key), few)
    contested, few = keep(groups.where((F.col("_n") > 1) | F.col("_held")))
    repeated = contested.where(~F.col("_held")).select(*keys)
    if repeated.isEmpty():
        marked = lookup.attach_kept(rows, contested, few, keys)
        refused = F.col("_n").isNotNull()
    else:
        if lookup.is_small(repeated):
            accepted = accepted.join(F.broadcast(repeated), keys, "left_semi")
        firsts = lookup.key_counts(accepted, keys, F.min(place).alias("_first")).drop("_n")
        marked = lookup.attach(rows, contested.join(firsts, keys, "left"), keys, keep=keep)
        refused = F.col("_n").isNotNull() & (F.col("_held") | (place != F.col("_first")))
    message = DUPLICATE.format(key=",".join(contract.primary_key))
    marked = marked.withColumn(REASON, F.coalesce(REASON, F.when(refused, message)))
    return marked.drop("_n", "_first", "_held")


def import_csv(
    spark: SparkSession,
    path: str,
    contract: Contract,
    mapping: dict[str, str] | None = None,
    parents: Callable[[str], DataFrame] | None = None,
    target: DataFrame | None = None,
    multi_line: bool = True,
) -> Checked:
    """Import CSV files; without a mapping, headers are matched to columns by name."""
    layout = sniff_csv(spark, path)
    raw = read_csv_text(spark, path, layout, multi_line)
    chosen = auto_map(layout.headers, contract.columns) if mapping is None else mapping
    return check_rows(raw, contract, chosen, list(POSITION), parents, target)


def reject_lines(rejects: DataFrame) -> DataFrame:
    """CSV records of rejects, original cells first and the reason last."""
    return csv_lines(rejects)


def observed_writes(
    checked: Checked, write_good: Callable[[DataFrame], None], write_rejects: Callable[[DataFrame], None]
) -> dict[str, int]:
    """Writes both kinds of rows and returns their counts, observed as they are written."""
    accepted, refused = Observation(), Observation()
    total = F.count(F.lit(1)).alias("rows")
    write_good(checked.good.observe(accepted, total))
    write_rejects(checked.rejects.observe(refused, total))
    return {"successful_rows": accepted.get["rows"], "failed_rows": refused.get["rows"]}


def write_import(checked: Checked, good_path: str, reject_path: str) -> dict[str, int]:
    """Write good rows as Parquet and rejects as CSV; returns the counts of both.

    The counts are observed while the rows are written, not by another pass. The
    staged rows are removed after, so an import is written once.
    """
    counts = observed_writes(checked, lambda df: df.write.parquet(good_path), lambda df: write_csv(df, reject_path))
    checked.stage.release()
    return counts
