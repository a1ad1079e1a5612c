"""What a table promises: columns, keys, references and allowed values."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class ForeignKey:
    column: str
    ref_table: str
    ref_column: str


@dataclass(frozen=True)
class Contract:
    table: str
    schema: T.StructType
    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    enums: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    required: frozenset[str] = frozenset()
    auto_increment: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        known = set(self.schema.names)
        named = {
            *self.primary_key,
            *(key.column for key in self.foreign_keys),
            *self.enums,
            *self.required,
            *self.auto_increment,
        }
        unknown = sorted(named - known)
        if unknown:
            raise ValueError(f"Unknown columns in contract of {self.table}: {', '.join(unknown)}")

    @property
    def columns(self) -> list[str]:
        return list(self.schema.names)

    @property
    def must_have_value(self) -> frozenset[str]:
        return self.required | frozenset(self.primary_key)

    def writable(self, for_update: bool = False) -> list[str]:
        """Columns a user may fill; on update the key stays as it is."""
        fixed = set(self.auto_increment)
        if for_update:
            fixed |= set(self.primary_key)
        return [name for name in self.columns if name not in fixed]
