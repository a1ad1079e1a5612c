"""A flat table split into related tables, all of them or none."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import kinds
from tablekit.sources import storage
from tablekit.sources.versions import Version, Versions

# Why a flat table cannot be split.
CONTRADICTION = "One key with unlike attributes."
COLLISION = "Unlike keys with one surrogate key."
INCOMPLETE = "Key with a missing part."
LOST_PARENT = "Row without a parent."


@dataclass(frozen=True)
class Entity:
    """A table to be: its natural key, what depends on it, and the entities it refers to.

    Rows whose natural key is all null have no such entity. ``required`` parents must be
    there for every row of this entity.
    """

    table: str
    key: tuple[str, ...]
    attributes: tuple[str, ...] = ()
    parents: tuple[str, ...] = ()
    required: frozenset[str] = frozenset()

    @property
    def surrogate(self) -> str:
        return f"{self.table}_id"


@dataclass(frozen=True)
class Normalized:
    """The split tables, parents first, and what speaks against publishing them.

    ``conflicts`` has a row per faulty surrogate key: ``table_name``, ``surrogate``,
    ``reason`` and ``variants``, the number of unlike rows it stands for.
    """

    tables: dict[str, DataFrame]
    conflicts: DataFrame
    stage: storage.Stage

    def publish(self, versions: Versions) -> Version:
        """Publishes all tables as one version; raises, and publishes nothing, on a conflict."""
        found = {row["table_name"]: row["n"] for row in self.conflicts.groupBy("table_name").agg(F.count(F.lit(1)).alias("n")).collect()}
        if found:
            raise ConflictError(found)
        before = versions.version()
        files = {name: versions.write(rows) for name, rows in self.tables.items()}
        version = versions.publish(files, {name: rows.schema for name, rows in self.tables.items()}, before)
        self.stage.release()
        return version


class ConflictError(ValueError):
    """The flat table contradicts itself; ``counts`` has the number of conflicts by table."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        listed = ", ".join(f"{name}: {n}" for name, n in sorted(counts.items()))
        super().__init__(f"Conflicts by table: {listed}. Nothing was published.")


def ordered(entities: Sequence[Entity]) -> list[Entity]:
    """Parents before their children; unknown parents and circles are errors."""
    by_name = {e.table: e for e in entities}
    if len(by_name) < len(entities):
        raise ValueError("Two entities share a table name.")
    done: dict[str, Entity] = {}
    while len(done) < len(entities):
        ready = [e for e in entities if e.table not in done and all(p in done for p in e.parents)]
        if not ready:
            left = sorted(set(by_name) - set(done))
            raise ValueError(f"Parents are unknown or refer to each other: {', '.join(left)}")
        done.update({e.table: e for e in ready})
    return list(done.values())


def surrogate_key(flat: DataFrame, key: Sequence[str], table: str) -> Column:
    """MD5 of the table and the parts of a natural key; null where a part is null.

    Parts carry their length, so unlike keys never give the same text.
    """
    texts = [_key_text(F.col(f"`{c}`"), flat.schema[c].dataType) for c in key]
    parts = [F.concat(F.char_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return F.md5(F.concat(F.lit(f"{table}:"), *parts))


def _key_text(value: Column, data_type: T.DataType) -> Column:
    """All of a value, unlike the text of files, which cuts instants to milliseconds."""
    return F.to_json(F.struct(value)) if isinstance(data_type, kinds.NESTED_TYPES) else value.cast("string")


def _check(flat: DataFrame, entities: Sequence[Entity]) -> None:
    for entity in entities:
        missing = sorted({*entity.key, *entity.attributes} - set(flat.columns))
        if missing or not entity.key:
            raise ValueError(f"Entity {entity.table} names unknown columns: {', '.join(missing) or 'no key'}")
        unfit = [c for c in (*entity.key, *entity.attributes) if not kinds.is_orderable(flat.schema[c].dataType)]
        if unfit:
            raise ValueError(f"Entity {entity.table} has columns that cannot be compared: {', '.join(unfit)}")
        if not entity.required <= set(entity.parents):
            raise ValueError(f"Entity {entity.table} requires what is no parent.")


def normalize_flat(flat: DataFrame, entities: Sequence[Entity]) -> Normalized:
    """Split a flat table; a key that stands in many rows must have one set of attributes.

    An entity is the distinct set of its columns, taken with partial aggregation, so a
    key that a third of all rows share is one row for each task. A child refers to its
    parent by the hash of the parent's key in the same flat row: no join is needed. All
    checks then read the distinct rows, which are staged. Two nulls count as equal and a
    null as unlike any value.
    """
    chosen = ordered(entities)
    _check(flat, chosen)
    by_name = {e.table: e for e in chosen}
    stage = storage.Stage()
    tables, conflicts = {}, []
    for entity in chosen:
        parts = [F.col(f"`{c}`") for c in entity.key]
        references = [surrogate_key(flat, by_name[p].key, p).alias(by_name[p].surrogate) for p in entity.parents]
        some = reduce(lambda a, b: a | b, [p.isNotNull() for p in parts])
        own = surrogate_key(flat, entity.key, entity.table).alias(entity.surrogate)
        attributes = [F.col(f"`{c}`") for c in entity.attributes]
        rows = flat.where(some).select(own, *parts, *references, *attributes).distinct()
        rows = stage.table(rows, entity.table)
        tables[entity.table] = rows
        conflicts.append(_conflicts(rows, entity, [by_name[p].surrogate for p in entity.parents]))
    return Normalized(tables, reduce(DataFrame.unionByName, conflicts), stage)


def _conflicts(rows: DataFrame, entity: Entity, references: list[str]) -> DataFrame:
    key = F.xxhash64(*[F.col(f"`{c}`") for c in entity.key])
    needed = [F.col(s).isNull() for s, p in zip(references, entity.parents, strict=True) if p in entity.required]
    orphan = reduce(lambda a, b: a | b, needed, F.lit(False))
    # Nothing but whole numbers is aggregated; unlike hashes come from unlike keys.
    groups = rows.groupBy(F.col(entity.surrogate).alias("surrogate")).agg(
        F.count(F.lit(1)).alias("variants"),
        F.min(key).alias("_low"),
        F.max(key).alias("_high"),
        F.count_if(orphan).alias("_orphans"),
    )
    reason = (
        F.when(F.col("surrogate").isNull(), INCOMPLETE)
        .when(F.col("_low") != F.col("_high"), COLLISION)
        .when(F.col("variants") > 1, CONTRADICTION)
        .when(F.col("_orphans") > 0, LOST_PARENT)
    )
    judged = groups.select(F.lit(entity.table).alias("table_name"), "surrogate", reason.alias("reason"), "variants")
    return judged.where(F.col("reason").isNotNull())
