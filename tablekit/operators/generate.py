"""Synthetic rows that respect references and allowed values.

Every value is a hash of seed, table, column and row id, so rows do not depend on
how many tasks make them, and a repeated task makes the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import fakes, kinds
from tablekit.operators import lookup
from tablekit.operators.dump import numbered_rows
from tablekit.plans import limits
from tablekit.plans.contract import Contract, ForeignKey

ROW_ID = "_row_id"

NO_PARENTS = "Nothing to refer to from {column}: {parent} has no keys."
NO_CHOICES = "Nothing to choose from for {column}: its list of allowed values is empty."

# Ranges of seeded numbers.
SEEDED_KEY_RANGE = (1, 100)
SEEDED_NUMBER_RANGE = (0, 1000)

def ids(spark: SparkSession, count: int, first: int = 1) -> DataFrame:
    return spark.range(first, first + count).select(F.col("id").alias(ROW_ID))


def row_hash(seed: int | str, table: str, column: str) -> Column:
    return fakes.digest((str(seed), table, column), F.col(ROW_ID).cast("string"))


# ---------------------------------------------------------------- seeded tables


def _type_words(data_type: T.DataType) -> str:
    """Type name in the words of a database, for the name and type rules."""
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, T.DecimalType):
        return "numeric"
    if isinstance(data_type, kinds.INTEGRAL_TYPES):
        return "integer"
    return data_type.simpleString()


@dataclass(frozen=True)
class _SeedRule:
    """A maker of values and the column names and types it is meant for."""

    applies: Callable[[str, str], bool]
    make: Callable[[Column], Column]
    makes_text: bool = True


def _name_has(*fragments: str) -> Callable[[str, str], bool]:
    return lambda name, _: any(f in name for f in fragments)


def _name_has_all(*fragments: str) -> Callable[[str, str], bool]:
    return lambda name, _: all(f in name for f in fragments)


def _type_has(*fragments: str) -> Callable[[str, str], bool]:
    return lambda _, kind: any(f in kind for f in fragments)


def _key_of(*fragments: str) -> Callable[[str, str], bool]:
    return lambda name, kind: name.endswith("_id") and any(f in kind for f in fragments)


# Rules in order, the first that applies makes the value.
WHOLE_TYPES = ("integer", "int", "numeric")
SEED_RULES = (
    _SeedRule(_key_of("uuid"), fakes.uuid),
    _SeedRule(_key_of(*WHOLE_TYPES), lambda h: fakes.number(h, *SEEDED_KEY_RANGE), False),
    _SeedRule(_name_has_all("first", "name"), fakes.first_name),
    _SeedRule(_name_has_all("last", "name"), fakes.last_name),
    _SeedRule(_name_has("email"), fakes.email),
    _SeedRule(_name_has("name"), fakes.company),
    _SeedRule(_name_has("city"), fakes.city),
    _SeedRule(_name_has("country"), fakes.country),
    _SeedRule(_name_has("zip", "postal"), fakes.zip_code),
    _SeedRule(_name_has("address", "street"), fakes.street_address),
    _SeedRule(_name_has("phone"), fakes.phone),
    _SeedRule(_name_has("url", "website"), fakes.url),
    _SeedRule(_name_has("company"), fakes.company),
    _SeedRule(_name_has("description", "bio"), fakes.two_sentences),
    _SeedRule(_type_has("varchar", "text", "string"), fakes.word),
    _SeedRule(_type_has(*WHOLE_TYPES), lambda h: fakes.number(h, *SEEDED_NUMBER_RANGE), False),
    _SeedRule(_type_has("boolean", "bool"), fakes.boolean, False),
    _SeedRule(_type_has("timestamp", "date"), fakes.recent_instant, False),
    # Fractions get a number too; a word would not fit their column.
    _SeedRule(_type_has("double", "float"), lambda h: fakes.number(h, *SEEDED_NUMBER_RANGE), False),
    _SeedRule(lambda *_: True, fakes.word),
)


def seed_value(field: T.StructField, h: Column) -> Column:
    """Value that suits the name and type of a column.

    Makers of text are passed over where the column cannot hold text.
    """
    name, kind = field.name.lower(), _type_words(field.dataType)
    holds_text = isinstance(field.dataType, (T.StringType, T.BinaryType))
    for rule in SEED_RULES:
        if rule.applies(name, kind) and (holds_text or not rule.makes_text):
            return rule.make(h).try_cast(field.dataType)
    return F.lit(None).cast(field.dataType)


def seedable(contract: Contract) -> list[T.StructField]:
    return [
        f
        for f in contract.schema.fields
        if f.name.lower() != "id" and f.name not in contract.auto_increment
    ]


def key_pool(parent: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Distinct places ``_slot`` for the keys of a referenced table.

    With a limit the smallest keys form the pool. Without one, all keys do.
    """
    keys = parent.where(F.col(f"`{column}`").isNotNull()).select(F.col(f"`{column}`").alias("_key"))
    if limit is None:
        return numbered_rows(keys, ["_key"], True, F.col("_key")).withColumnRenamed("_index", "_slot")
    few = keys.orderBy("_key").limit(limit).agg(F.sort_array(F.collect_list("_key")).alias("keys"))
    return few.select(F.posexplode("keys").alias("_slot", "_key")).withColumn(
        "_slot", F.col("_slot").cast("bigint")
    )


def _with_reference(
    rows: DataFrame, table: str, key: ForeignKey, parent: DataFrame, seed: int | str, limit: int | None
) -> DataFrame:
    pool = key_pool(parent, key.ref_column, limit)
    size = pool.count()
    if size == 0:
        raise ValueError(NO_PARENTS.format(column=f"{table}.{key.column}", parent=f"{key.ref_table}.{key.ref_column}"))
    slot = fakes.below(row_hash(seed, table, key.column), 1, size, digits=15)
    side = pool.select(F.col("_slot").alias("_wanted"), F.col("_key").alias(key.column))
    if size <= lookup.MAX_BROADCAST_ROWS:
        side = F.broadcast(side)  # counted above; larger pools share the rows out evenly
    return rows.join(side, slot == F.col("_wanted"), "left").drop("_wanted")


def seed_rows(
    row_ids: DataFrame,
    contract: Contract,
    seed: int | str,
    parents: Callable[[str], DataFrame] | None = None,
    pool_limit: int | None = None,
) -> DataFrame:
    """One synthetic row per id. References come first, then allowed values, then
    the rules on name and type. ``id`` and counted columns are left out."""
    references = {key.column: key for key in contract.foreign_keys}
    fields = seedable(contract)
    for name, domain in contract.enums.items():
        if not domain and name not in references:
            raise ValueError(NO_CHOICES.format(column=name))
    made = {}
    for field in fields:
        h = row_hash(seed, contract.table, field.name)
        if field.name in references:
            continue
        if field.name in contract.enums:
            made[field.name] = fakes.choice(h, tuple(contract.enums[field.name]))
        else:
            made[field.name] = seed_value(field, h)
    rows = row_ids.select(ROW_ID, *[value.alias(name) for name, value in made.items()])
    for field in fields:
        if field.name in references:
            if parents is None:
                raise ValueError(f"Cannot seed {field.name}: its referenced table is not given.")
            key = references[field.name]
            rows = _with_reference(rows, contract.table, key, parents(key.ref_table), seed, pool_limit)
    return rows.select(ROW_ID, *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])


def seed_table(
    spark: SparkSession,
    contract: Contract,
    count: int = limits.DEFAULT_SEED_ROWS,
    seed: int | str = 0,
    parents: Callable[[str], DataFrame] | None = None,
) -> DataFrame:
    if isinstance(count, bool) or not isinstance(count, int) or count < 1:
        raise ValueError("The number of rows must be a positive whole number.")
    return seed_rows(ids(spark, count), contract, seed, parents).drop(ROW_ID)
