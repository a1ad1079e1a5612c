"""Driver tables, their contracts, and the form of a registered query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablekit.plans.contract import Contract, ForeignKey
from tablekit.session import tune
from tablekit.sources.catalog import Catalog

TABLES = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
    "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
)

PRIMARY_KEYS = {
    "benchmark": ("item_id",),
    "conversations": ("conv_id", "turn"),
    "customer": ("c_custkey",),
    "documents": ("doc_id",),
    "embeddings": ("vec_id",),
    "events": ("event_id",),
    "labels": ("doc_id",),
    "nation": ("n_nationkey",),
    "orders": ("o_orderkey",),
    "pages": ("page_id",),
    "part": ("p_partkey",),
    "region": ("r_regionkey",),
    "supplier": ("s_suppkey",),
}

FOREIGN_KEYS = {
    "customer": (ForeignKey("c_nationkey", "nation", "n_nationkey"),),
    "labels": (ForeignKey("doc_id", "documents", "doc_id"),),
    "lineitem": (
        ForeignKey("l_orderkey", "orders", "o_orderkey"),
        ForeignKey("l_partkey", "part", "p_partkey"),
        ForeignKey("l_suppkey", "supplier", "s_suppkey"),
    ),
    "nation": (ForeignKey("n_regionkey", "region", "r_regionkey"),),
    "orders": (ForeignKey("o_custkey", "customer", "c_custkey"),),
    "supplier": (ForeignKey("s_nationkey", "nation", "n_nationkey"),),
}

ENUMS = {"orders": {"o_orderstatus": ("F", "O", "P")}}
REQUIRED = {"orders": frozenset({"o_custkey"})}


@dataclass(frozen=True)
class Query:
    """A query over a table folder and, where SQL can say it, its twin in SQL."""

    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def contract(name: str, df: DataFrame) -> Contract:
    return Contract(
        name,
        df.schema,
        PRIMARY_KEYS.get(name, ()),
        FOREIGN_KEYS.get(name, ()),
        ENUMS.get(name, {}),
        REQUIRED.get(name, frozenset()),
    )


def open_catalog(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> Catalog:
    """Catalog of the named tables; a contract is made when its table is asked for."""
    return _ContractedCatalog.of_parquet(tune(spark), folder, names)


class _ContractedCatalog(Catalog):
    def contract(self, name: str) -> Contract:
        return contract(name, self.table(name))

    def select(self, names: list[str] | None) -> Catalog:
        if not names:
            return self
        self.require(names)
        return _ContractedCatalog({n: o for n, o in self._openers.items() if n in set(names)})


# --------------------------------------------------- pieces of the SQL twins


def sql_number(value: str) -> str:
    """Text of a double with few digits."""
    return f"(CASE WHEN {value} = 0 THEN '0' ELSE regexp_replace(CAST({value} AS VARCHAR), '\\.0$', '') END)"


def sql_iso(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def sql_hash(domain: tuple[str, ...], text: str) -> str:
    prefix = " || ".join(f"'{part}' || chr(31)" for part in domain)
    return f"md5({prefix} || {text})"


def sql_hex(h: str, start: int, digits: int = 8) -> str:
    return f"CAST('0x' || substr({h}, {start}, {digits}) AS BIGINT)"


def sql_pick(values: tuple[str, ...], h: str, start: int) -> str:
    words = ", ".join(f"'{v}'" for v in values)
    return f"[{words}][{sql_hex(h, start)} % {len(values)} + 1]"
