"""The jobs: load raw documents, clean an entity, build the gold table."""

from __future__ import annotations

import datetime as dt
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks, contract, daily_weather, keyed
from ..operators.rules import split, with_reasons
from ..sources.config import Source
from ..sources.raw import read_raw
from ..store import ddl, maintenance
from ..store.lake import Lake, Table
from .entities import POPULATIONS, READINGS, Entity

BRONZE, SILVER, GOLD = "00_bronze", "01_silver", "02_gold"
GOLD_TABLE = "agg_readings_daily"


class EmptyBatch(ValueError):
    """A batch that should have rows has none."""


def load_raw(lake: Lake, source: Source, date: dt.date, batch_id: str, landing: str | Path, at: dt.datetime | None = None) -> dict[str, Any]:
    """Appends a date's raw documents to the source's bronze table."""
    table = lake.table(BRONZE, source.bronze_table)
    when = None if at is None else F.lit(at).cast("timestamp")
    df = read_raw(lake.spark, table.load().struct, source, date, landing, batch_id, when)
    snapshot = table.append(df)
    if snapshot is None:
        raise EmptyBatch(f"no documents of {source.bronze_table} for {date}")
    return {"table": str(table), "rows": int(table.snapshot(snapshot)["summary"]["added-records"]), "snapshot_id": snapshot}


def _stored_bounds(df: DataFrame, column: str | None) -> dict[str, tuple[Any, Any]] | None:
    """Literal bounds of a batch, to read only the stored files in its range."""
    if column is None:
        return None
    # Formatted in Spark and read as UTC, so that the driver's zone has no part in it.
    low, high = df.agg(*[F.date_format(f(column), "yyyy-MM-dd HH:mm:ss.SSSSSS") for f in (F.min, F.max)]).first()
    if low is None:
        return None
    return {column: tuple(dt.datetime.strptime(x, "%Y-%m-%d %H:%M:%S.%f").replace(tzinfo=dt.timezone.utc) for x in (low, high))}


def clean_rows(lake: Lake, entity: Entity, bronze: DataFrame, require_rows: bool = True) -> dict[str, Any]:
    """Checks, splits, deduplicates, reconciles, classifies, then merges what is new or changed.

    Silver and quarantine are two commits; both are idempotent, so a crash between them is
    mended by running again.
    """
    silver, quarantine = lake.table(SILVER, entity.name), lake.table(SILVER, f"{entity.name}_quarantine")
    at = F.lit(dt.datetime.now(dt.timezone.utc)).cast("timestamp")
    checked = with_reasons(entity.prepare(bronze), entity.rules()).cache()
    try:
        counts = keyed.split_counts(checked, entity.key)
        if not counts["input"]:
            if require_rows:
                raise EmptyBatch(f"no rows of {entity.name} in the batch")
            return counts | {c: 0 for c in keyed.CLASSES} | {"snapshot_id": None, "quarantine_snapshot_id": None}
        valid, rejected = split(checked)
        unique = keyed.dedup_latest(valid, entity.key, entity.prefer(), tiebreak=entity.tiebreak)
        updates = contract.require(unique.withColumn("_merged_at", at).select(*entity.columns), silver.load().struct, str(silver))
        rejects = contract.require(rejected.withColumn("_quarantined_at", at).select(*entity.quarantine_columns), quarantine.load().struct, str(quarantine))
        prune = _stored_bounds(valid, entity.bounded_by)
        classified = keyed.classify(updates, silver.read(prune), entity.key, entity.values).cache()
        try:
            changes = keyed.change_counts(classified)
            report = counts | changes | {"snapshot_id": None, "quarantine_snapshot_id": None}
            if counts["rejected"]:
                report["quarantine_snapshot_id"] = quarantine.insert_new(rejects, entity.quarantine_match)
            if changes["new"] or changes["changed"]:
                report["snapshot_id"] = silver.merge(keyed.to_merge(classified), entity.key, entity.values, "_ingested_at", prune=prune)["snapshot_id"]
            return report
        finally:
            classified.unpersist()
    finally:
        checked.unpersist()


def clean(lake: Lake, entity: Entity, bronze_table: str, batch_id: str) -> dict[str, Any]:
    """Cleans one batch of a bronze table."""
    bronze = lake.table(BRONZE, bronze_table).read().where(F.col("_batch_id") == batch_id)
    return clean_rows(lake, entity, bronze) | {"batch_id": batch_id, "entity": entity.name}


def build_gold(lake: Lake) -> dict[str, Any]:
    """Rebuilds the daily table and publishes it if every check passes and rows changed."""
    target: Table = lake.table(GOLD, GOLD_TABLE)
    silver = lake.table(SILVER, READINGS.name).read()
    gold = daily_weather.build(silver, lake.table(SILVER, POPULATIONS.name).read()).cache()
    try:
        checks.require_passed(checks.daily_weather_checks(gold, silver, daily_weather.REQUIRED))
        contract.require(gold, target.load().struct, str(target))
        changed = target.load().current is None or keyed.differs(gold, target.read())
        if changed:
            target.overwrite(gold)
        return {"rows": gold.count(), "published": changed, "snapshot_id": target.load().current["id"]}
    finally:
        gold.unpersist()


def apply_ddl(lake: Lake, folder: str | Path, values: dict[str, str] | None = None, dry_run: bool = False) -> dict[str, Any]:
    """Applies the migrations in a folder that haven't been applied yet."""
    names = {"bronze_db": BRONZE, "silver_db": SILVER, "gold_db": GOLD, "ops_db": "ops"} | (values or {})
    return ddl.apply(lake, ddl.load(folder), names, dry_run)


def maintain_tables(lake: Lake, options: maintenance.Options = maintenance.Options(), databases: list[str] | None = None, tables: list[str] | None = None, watermark_table: tuple[str, str] = ("ops", "watermarks"), current: dt.datetime | None = None) -> list[dict[str, Any]]:
    """Maintains all tables; what a stream hasn't read yet doesn't expire."""
    from ..streaming.cleaner import watermark_of

    marks = lake.table(*watermark_table)
    return maintenance.maintain(lake, options, databases, tables, lambda t: watermark_of(marks, t), current)
