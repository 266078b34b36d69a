"""The incremental cleaner: bronze snapshots to silver, with a forward-only watermark.

The first run cleans the current snapshot as batch -1 and starts the stream after it;
later runs resume from the checkpoint.  There is no event-time watermark: late rows are
merged at their own minute.  Delivery is at least once and the merge is idempotent.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections import Counter
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from ..plans.entities import SENSOR_READINGS, Entity
from ..plans.jobs import BRONZE, clean_rows
from ..plans.pipeline import single_writer
from ..store.lake import Lake, Table
from ..store.stream_source import NAME, SnapshotSource

WATERMARK_SCHEMA = "process string not null, source_table string not null, snapshot_id long not null, snapshot_committed_at timestamp not null, last_run string not null"


def advance(table: Table, process: str, source: Table, snapshot_id: int, report: dict[str, Any]) -> bool:
    """Moves a process's watermark to a snapshot; never back."""
    committed = dt.datetime.fromisoformat(source.snapshot(snapshot_id)["committed_at"])
    row = table.spark.createDataFrame([(process, str(source), snapshot_id, committed, json.dumps(report))], table.load().struct)
    done = table.merge(row, ["process"], at="snapshot_id")
    return bool(done["updated"] + done["inserted"])


def watermark_of(table: Table, source: Table) -> dt.datetime | None:
    """The least commit time that some process has reached in a source; None without any."""
    if not table.exists():
        return None
    ids = [r["snapshot_id"] for r in table.read().where(f"source_table = '{source}'").collect()]
    times = [s["committed_at"] for s in source.load().snapshots if ids and s["id"] >= min(ids)]
    return dt.datetime.fromisoformat(times[0]) if times else None


def clean_stream(lake: Lake, checkpoint: str | Path, watermarks: Table, bronze_table: str = "simulator_readings", entity: Entity = SENSOR_READINGS) -> dict[str, Any]:
    """One run over everything that has been appended since the last."""
    source = lake.table(BRONZE, bronze_table)
    spark = lake.spark
    checkpoint = Path(checkpoint)
    with single_writer(checkpoint.parent / f".{checkpoint.name}.lock"):
        totals: Counter[str] = Counter()
        first = checkpoint.parent / f".{checkpoint.name}.first"

        def batch(df: DataFrame, number: int) -> None:
            done = clean_rows(lake, entity, df, require_rows=False)
            totals.update({k: v for k, v in done.items() if isinstance(v, int) and not k.endswith("snapshot_id")})

        start = int(first.read_text()) if first.exists() else 0
        if not (checkpoint / "offsets").exists() and not first.exists():
            current = source.snapshot()
            if current is None:
                return {"snapshot_id": None}
            start = current["id"]
            batch(source.read(snapshot_id=start), -1)
            first.parent.mkdir(parents=True, exist_ok=True)
            first.write_text(str(start))
        spark.dataSource.register(SnapshotSource)
        stream = spark.readStream.format(NAME).option("path", str(source.path)).option("start_snapshot", start).load()
        query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination()
        progress = query.lastProgress
        # A Python source's offset comes back as the text of a dict.
        end = re.search(r"snapshot_id\W+(\d+)", str(progress["sources"][0]["endOffset"])) if progress else None
        reached = int(end[1]) if end else start
        report = dict(totals)
        moved = advance(watermarks, f"clean_{entity.name}", source, reached, report) if reached else False
        return report | {"snapshot_id": reached, "watermark_moved": moved}
