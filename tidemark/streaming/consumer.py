"""Queue to bronze: typed rows and rejects are appended, then the latest view is moved.

A batch has at most ``FILES_AT_ONCE`` files of the queue.  Messages of a table that can't be
written go back to the queue, by Spark, with one more try; after ``ATTEMPTS`` tries, in one run or
in several, they go to the dead letters.
"""

from __future__ import annotations

import datetime as dt
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.messages import latest_per_station, read_queue, split_messages
from ..store.lake import Lake

ATTEMPTS = 3
#: 100 messages in files of ten.
FILES_AT_ONCE = 10


def publish_latest(lake: Lake, db: str, name: str, latest: DataFrame) -> dict[str, int]:
    """Moves each station's latest reading forward only; an older one is skipped."""
    table = lake.table(db, name)
    schema = table.load().struct
    rows = latest.select(*[F.col(f.name).cast(f.dataType) for f in schema]).cache()
    try:
        done = table.merge(rows, ["station_id"], at="observed_at", strict=True)
        moved = done["updated"] + done["inserted"]
        return {"updated": moved, "late_skipped": rows.count() - moved}
    finally:
        rows.unpersist()


def consume(lake: Lake, records: DataFrame, batch_id: str, db: str = "00_bronze", table: str = "simulator_readings", latest: tuple[str, str] | None = None) -> tuple[dict[str, Any], DataFrame | None]:
    """(report, ids of the messages that must come again).

    One try per sink: what fails is reported by table, and only its messages come again.
    The latest view is derived, so its failure is only reported.
    """
    at = F.lit(dt.datetime.now(dt.timezone.utc)).cast("timestamp")
    rows, rejects = split_messages(records, batch_id, at)
    report: dict[str, Any] = {"failed": {}}
    again: DataFrame | None = None
    for name, df in ((table, rows), (f"{table}_quarantine", rejects)):
        try:
            report[name] = lake.table(db, name).append(df)
        except Exception as e:  # noqa: BLE001  one table's failure is that table's alone
            report["failed"][name] = str(e).splitlines()[0]
            ids = df.select("_message_id")
            again = ids if again is None else again.unionAll(ids)
    if latest and table not in report["failed"]:
        try:
            report["latest"] = publish_latest(lake, *latest, latest_per_station(rows))
        except Exception as e:  # noqa: BLE001
            report["latest_error"] = str(e).splitlines()[0]
    return report, again


def run_consumer(lake: Lake, queue: str | Path, checkpoint: str | Path, dead_letters: str | Path, table: str = "simulator_readings", latest: tuple[str, str] | None = None, files_at_once: int = FILES_AT_ONCE) -> list[dict[str, Any]]:
    """Consumes what the queue holds at the start; what is put back waits for the next run."""
    reports: list[dict[str, Any]] = []

    def batch(df: DataFrame, number: int) -> None:
        here = df.withColumn("tries", F.coalesce("tries", F.lit(0)) + 1).cache()
        try:
            report, again = consume(lake, here, f"stream-{number}", table=table, latest=latest)
            if again is not None:
                failed = here.join(again.distinct(), F.col("messageId") == F.col("_message_id"), "left_semi")
                failed.where(F.col("tries") < ATTEMPTS).write.mode("append").json(str(queue))
                dead = failed.where(F.col("tries") >= ATTEMPTS).withColumn("error", F.lit("; ".join(f"{k}: {v}" for k, v in report["failed"].items())))
                report["dead"] = dead.count()
                if report["dead"]:
                    dead.write.mode("append").json(str(dead_letters))
            reports.append(report)
        finally:
            here.unpersist()

    query: StreamingQuery = read_queue(lake.spark, str(queue), files_at_once).writeStream.foreachBatch(batch).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    return reports
