"""Checks before publishing: one pass over the result, one over its source."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    name: str
    passed: bool
    detail: str


class DataQualityError(ValueError):
    """At least one check failed; nothing was published."""


def measure_table(df: DataFrame, key: Sequence[str], conditions: dict[str, Column], sums: dict[str, str]) -> dict[str, float]:
    """rows, distinct keys, rows under each condition, and sums, in one aggregate."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(F.struct(*key)).alias("keys"),
        *[F.count_if(c).alias(n) for n, c in conditions.items()],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()],
    ).first()
    return row.asDict()


# Names, range of hours, and slack of the daily weather checks.
def daily_weather_checks(gold: DataFrame, silver: DataFrame, required: Sequence[str]) -> list[Check]:
    """The eight checks of a daily weather table against the hourly rows that it sums."""
    absent = F.lit(False)
    for c in required:
        absent = absent | F.col(c).isNull()
    low, mean, high, slack = F.col("temperature_min_c"), F.col("temperature_avg_c"), F.col("temperature_max_c"), 1e-9
    g = measure_table(
        gold,
        ["station_id", "reading_date"],
        {
            "nulls": absent,
            "hours": ~F.col("hours_observed").between(1, 24),
            "order": ~((low <= mean + slack) & (mean <= high + slack)),
            "population": F.col("population").isNull(),
        },
        {"total_hours": "hours_observed", "rain": "precipitation_total_mm"},
    )
    s = silver.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("precipitation_mm"), F.lit(0.0)).alias("rain")).first()
    return [
        Check("not_empty", g["rows"] > 0, f"{g['rows']} rows"),
        Check("unique_key", g["rows"] == g["keys"], f"{g['rows']} rows, {g['keys']} keys"),
        Check("required_not_null", g["nulls"] == 0, f"{g['nulls']} rows with nulls"),
        Check("hours_in_range", g["hours"] == 0, f"{g['hours']} rows outside 1 to 24"),
        Check("temperature_order", g["order"] == 0, f"{g['order']} rows out of order"),
        Check("population_found", g["population"] == 0, f"{g['population']} rows without"),
        Check("hours_reconcile", g["total_hours"] == s["rows"], f"{g['total_hours']} hours, {s['rows']} source rows"),
        Check("precipitation_reconciles", abs(g["rain"] - s["rain"]) < 1e-6, f"{g['rain']} against {s['rain']}"),
    ]


def require_passed(checks: Sequence[Check]) -> None:
    failed = [c for c in checks if not c.passed]
    if failed:
        raise DataQualityError("; ".join(f"{c.name}: {c.detail}" for c in failed))
