"""Tables by name, with their contracts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tablekit.plans.contract import Contract


class Catalog:
    """Named tables, opened on first use so that unused ones cost nothing."""

    def __init__(
        self,
        openers: Mapping[str, Callable[[], DataFrame]],
        contracts: Mapping[str, Contract] | None = None,
    ) -> None:
        self._openers = dict(openers)
        self._opened: dict[str, DataFrame] = {}
        self._contracts = dict(contracts or {})

    @classmethod
    def of(
        cls, tables: Mapping[str, DataFrame], contracts: Mapping[str, Contract] | None = None
    ) -> Catalog:
        return cls({name: (lambda df=df: df) for name, df in tables.items()}, contracts)

    @classmethod
    def of_parquet(
        cls,
        spark: SparkSession,
        directory: str,
        names: Iterable[str],
        contracts: Mapping[str, Contract] | None = None,
    ) -> Catalog:
        """Tables kept as ``<directory>/<name>.parquet``, a file or a folder each."""

        def opener(name: str) -> Callable[[], DataFrame]:
            return lambda: spark.read.parquet(f"{directory}/{name}.parquet")

        return cls({name: opener(name) for name in names}, contracts)

    @property
    def names(self) -> list[str]:
        return sorted(self._openers)

    def table(self, name: str) -> DataFrame:
        if name not in self._openers:
            raise KeyError(f"Unknown table: {name}")
        if name not in self._opened:
            self._opened[name] = self._openers[name]()
        return self._opened[name]

    def require(self, names: list[str]) -> None:
        unknown = sorted(set(names) - set(self._openers))
        if unknown:
            raise KeyError(f"Unknown tables: {', '.join(unknown)}")

    def contract(self, name: str) -> Contract:
        """Declared contract, or one that only knows the columns."""
        if name in self._contracts:
            return self._contracts[name]
        return Contract(name, self.table(name).schema)

    def select(self, names: list[str] | None) -> Catalog:
        """Only the named tables; no names means all, an unknown name is an error."""
        if not names:
            return self
        self.require(names)
        chosen = [name for name in self._openers if name in set(names)]
        return Catalog({name: self._openers[name] for name in chosen}, self._contracts)
