"""Validation: every broken rule of a row by name, and the split that follows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = "rejection_reasons"


@dataclass(frozen=True)
class Rule:
    """``broken`` true means that the row breaks the rule; null means that it doesn't."""

    name: str
    broken: Column


def with_reasons(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds the names of the broken rules in rule order; an empty array is a valid row."""
    if not rules:
        return df.withColumn(REASONS, F.expr("cast(array() as array<string>)"))
    return df.withColumn(REASONS, F.array_compact(F.array(*[F.when(r.broken, F.lit(r.name)) for r in rules])))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected); the reasons are never null, so each row is on one side."""
    return df.where(F.size(REASONS) == 0), df.where(F.size(REASONS) > 0)


def missing(column: str, label: str | None = None) -> Rule:
    return Rule(f"missing_{label or column}", F.col(column).isNull())


def outside(column: str, low: float, high: float) -> Rule:
    """A present value that isn't in [low, high]; NaN is outside."""
    return Rule(f"out_of_range_{column}", ~F.col(column).between(low, high))


def unit_differs(column: str, actual: Column, unit: str) -> Rule:
    return Rule(f"unexpected_unit_{column}", ~actual.eqNullSafe(F.lit(unit)))
