"""Entities: how bronze rows of each kind become checked rows, and the columns they keep."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import local_to_instant, size_or_minus_one, text_to_instant, whole_number
from ..operators.rules import Rule, missing, outside, unit_differs

# Measures with their source names, units and accepted ranges.
MEASURES = {
    "temperature_c": ("temperature_2m", "°C", -90.0, 60.0),
    "relative_humidity_pct": ("relative_humidity_2m", "%", 0, 100),
    "precipitation_mm": ("precipitation", "mm", 0.0, 500.0),
    "wind_speed_kmh": ("wind_speed_10m", "km/h", 0.0, 500.0),
}
PREFERRED_RANK = "PreferredRank"
DEPRECATED_RANK = "DeprecatedRank"


@dataclass(frozen=True)
class Entity:
    """One silver entity."""

    name: str
    key: tuple[str, ...]
    values: tuple[str, ...]
    columns: tuple[str, ...]
    quarantine_columns: tuple[str, ...]
    quarantine_match: tuple[str, ...]
    prepare: Callable[[DataFrame], DataFrame]
    rules: Callable[[], Sequence[Rule]]
    prefer: Callable[[], Sequence[Column]] = lambda: ()
    tiebreak: tuple[str, ...] = ("_batch_id",)
    bounded_by: str | None = None


def _measure_rules() -> list[Rule]:
    out = []
    for name, (_, _, low, high) in MEASURES.items():
        out += [missing(name), outside(name, low, high)]
    return out


def flatten_hourly(bronze: DataFrame) -> DataFrame:
    """One row per hour of the parallel arrays; payloads without hours give no row."""
    arrays = {name: F.col(f"hourly.{raw}") for name, (raw, _, _, _) in MEASURES.items()}
    same = F.lit(True)
    for a in arrays.values():
        same = same & (size_or_minus_one(a) == F.size("hourly.time"))
    keep = ["station_id", "_batch_id", "_source_file", "_ingested_at", "utc_offset_seconds"]
    units = [F.col(f"hourly_units.{raw}").alias(f"__unit_{name}") for name, (raw, _, _, _) in MEASURES.items()]
    rows = bronze.select(*keep, *units, same.alias("__same_lengths"), *[a.alias(f"__a_{n}") for n, a in arrays.items()], F.posexplode("hourly.time").alias("__i", "observed_at_raw"))
    return rows.withColumns({n: F.get(f"__a_{n}", F.col("__i")) for n in arrays}).drop("__i", *[f"__a_{n}" for n in arrays])


def payloads_without_rows(bronze: DataFrame) -> int:
    """Documents that flattening leaves out, as their array is null or empty."""
    return bronze.where(size_or_minus_one(F.col("hourly.time")) <= 0).count()


def _prepare_weather(bronze: DataFrame) -> DataFrame:
    return flatten_hourly(bronze).withColumn("observed_at", local_to_instant(F.col("observed_at_raw"), F.col("utc_offset_seconds")))


def _weather_rules() -> list[Rule]:
    ids = [missing("station_id"), Rule("invalid_observed_at", F.col("observed_at").isNull()), Rule("array_lengths_differ", ~F.col("__same_lengths"))]
    return [*ids, *_measure_rules(), *[unit_differs(n, F.col(f"__unit_{n}"), unit) for n, (_, unit, _, _) in MEASURES.items()]]


def _prepare_population(bronze: DataFrame) -> DataFrame:
    keep = ["station_id", "_batch_id", "_source_file", "_ingested_at"]
    rows = bronze.select(*keep, F.explode("results.bindings").alias("b"))
    rows = rows.select(*keep, F.col("b.point_in_time.value").alias("point_in_time_raw"), F.col("b.population.value").alias("population_raw"), F.col("b.rank.value").alias("rank_raw"))
    number = F.col("population_raw").try_cast("decimal(38,6)")
    date = F.try_to_timestamp(F.substring("point_in_time_raw", 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    return rows.withColumns({"__number": number, "population": whole_number(number), "reference_date": date, "is_preferred_rank": F.coalesce(F.col("rank_raw").endswith(PREFERRED_RANK), F.lit(False))})


def _population_rules() -> list[Rule]:
    number = F.col("__number")
    return [
        missing("station_id"),
        missing("point_in_time_raw", "point_in_time"),
        Rule("invalid_point_in_time", F.col("point_in_time_raw").isNotNull() & F.col("reference_date").isNull()),
        missing("population_raw", "population"),
        Rule("invalid_population", F.col("population_raw").isNotNull() & (number.isNull() | ((number == F.floor(number)) & F.col("population").isNull()))),
        Rule("non_positive_population", number <= 0),
        Rule("fractional_population", number != F.floor(number)),
        Rule("deprecated_rank", F.col("rank_raw").endswith(DEPRECATED_RANK)),
    ]


def _prepare_sensor(bronze: DataFrame) -> DataFrame:
    return bronze.withColumnRenamed("observed_at", "observed_at_raw").withColumn("observed_at", text_to_instant(F.col("observed_at_raw")))


def _sensor_rules() -> list[Rule]:
    return [missing("station_id"), Rule("invalid_observed_at", F.col("observed_at").isNull()), *_measure_rules()]


_M = tuple(MEASURES)
READINGS = Entity(
    "readings",
    ("station_id", "observed_at"),
    _M,
    ("station_id", "observed_at", *_M, "_batch_id", "_source_file", "_ingested_at", "_merged_at"),
    ("station_id", "observed_at_raw", "observed_at", *_M, "rejection_reasons", "_batch_id", "_source_file", "_ingested_at", "_quarantined_at"),
    ("station_id", "observed_at_raw", "_batch_id", "_source_file"),
    _prepare_weather,
    _weather_rules,
    bounded_by="observed_at",
)
POPULATIONS = Entity(
    "populations",
    ("station_id", "reference_date"),
    ("population", "is_preferred_rank"),
    ("station_id", "reference_date", "population", "is_preferred_rank", "_batch_id", "_source_file", "_ingested_at", "_merged_at"),
    ("station_id", "point_in_time_raw", "population_raw", "rank_raw", "reference_date", "population", "rejection_reasons", "_batch_id", "_source_file", "_ingested_at", "_quarantined_at"),
    ("station_id", "point_in_time_raw", "population_raw", "rank_raw", "_batch_id"),
    _prepare_population,
    _population_rules,
    prefer=lambda: (F.col("is_preferred_rank").desc_nulls_last(),),
    tiebreak=("_batch_id", "population"),
)
SENSOR_READINGS = Entity(
    "sensor_readings",
    ("station_id", "observed_at"),
    _M,
    ("station_id", "observed_at", *_M, "event_id", "_batch_id", "_message_id", "_ingested_at", "_merged_at"),
    ("event_id", "station_id", "observed_at_raw", "observed_at", *_M, "rejection_reasons", "_batch_id", "_message_id", "_ingested_at", "_quarantined_at"),
    ("_message_id",),
    _prepare_sensor,
    _sensor_rules,
    tiebreak=("_batch_id", "_message_id"),
    bounded_by="observed_at",
)
ENTITIES = {e.name: e for e in (READINGS, POPULATIONS, SENSOR_READINGS)}
