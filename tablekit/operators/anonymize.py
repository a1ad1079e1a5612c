"""Rule-driven replacement of column values."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablekit.functions import fakes, kinds, key_cipher, rendering

# Fixed value: what a redacted value turns into.
REDACTED = "[REDACTED]"

# The method whose fakes of unlike keys are unlike.
KEY_METHOD = "faker:key"
METHODS = ("mask", "redact", "null", *fakes.FAKES, "faker:text", "faker:number", KEY_METHOD)


@dataclass(frozen=True)
class Rule:
    """Replace ``column`` of ``table``.

    Fakes are keyed by table and column, so one value gets different fakes in two
    tables. Rules that name the same ``scope`` share their fakes instead, which
    keeps keys joinable. Only ``faker:key`` gives unlike values unlike fakes: whole
    numbers are permuted, among all numbers of the column's type or those from 0 up to
    ``below``; other keys are hashed. Columns that share a scope need one type.
    """

    table: str
    column: str
    method: str
    mask_char: str = "*"
    preserve_start: int = 0
    preserve_end: int = 0
    max_length: int | None = None
    low: int = fakes.NUMBER_RANGE[0]
    high: int = fakes.NUMBER_RANGE[1]
    scope: str | None = None
    below: int | None = None

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"Unknown anonymization method: {self.method}")
        if self.preserve_start < 0 or self.preserve_end < 0:
            raise ValueError("Preserved lengths must not be negative.")
        if self.low > self.high:
            raise ValueError("The lowest number must not exceed the highest.")
        if self.below is not None and self.below < 1:
            raise ValueError("The bound of key fakes must be positive.")
        if self.max_length is not None and self.max_length < 1:
            raise ValueError("The text length must be positive.")


def mask(text: Column, char: str = "*", start: int = 0, end: int = 0) -> Column:
    """Text with all but its ends replaced; short text is replaced whole."""
    length = F.length(text)
    middle = F.repeat(F.lit(char), length - start - end)
    return F.when(length <= start + end, F.repeat(F.lit(char), length)).otherwise(
        F.concat(F.left(text, F.lit(start)), middle, F.right(text, F.lit(end)))
    )


def _replacement(value: Column, data_type: T.DataType, rule: Rule, seed: str) -> Column:
    if rule.method == "null":
        return F.lit(None).cast(data_type)
    text = rendering.text_of(value, data_type)
    if rule.method == "mask":
        return mask(text, rule.mask_char, rule.preserve_start, rule.preserve_end)
    if rule.method == "redact":
        return F.when(value.isNotNull(), F.lit(REDACTED))
    domain = (rule.scope,) if rule.scope else (rule.table, rule.column)
    if rule.method == KEY_METHOD:
        if isinstance(data_type, kinds.INTEGRAL_TYPES):
            return key_cipher.permuted_key(value, data_type, (seed, *domain), rule.below)
        return key_cipher.hashed_key(rendering.text_of(value, data_type, micros=True), (seed, *domain))
    h = fakes.digest((seed, *domain), text)
    if rule.method == "faker:number":
        return fakes.number(h, rule.low, rule.high)
    if rule.method == "faker:text":
        return fakes.sentence(h, rule.max_length)
    return fakes.FAKES[rule.method](h)


def anonymize(df: DataFrame, table: str, rules: list[Rule], seed: int | str) -> DataFrame:
    """Table with its rules applied in order; rules on one column build on each other.

    Each rule is one expression in one projection, apart from a chain on a single
    column, whose steps are projections of their own so that text is not repeated.
    """
    present = [rule for rule in rules if rule.table == table and rule.column in df.columns]
    seen: Counter[str] = Counter()
    rounds: list[list[Rule]] = []
    for rule in present:
        if seen[rule.column] == len(rounds):
            rounds.append([])
        rounds[seen[rule.column]].append(rule)
        seen[rule.column] += 1
    for batch in rounds:
        types = {field.name: field.dataType for field in df.schema.fields}
        replaced = {
            rule.column: _replacement(F.col(f"`{rule.column}`"), types[rule.column], rule, str(seed))
            for rule in batch
        }
        df = df.withColumns(replaced)
    return df
