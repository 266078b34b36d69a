"""A Structured Streaming source over the appended snapshots of a snapshot table.

``spark.readStream.format("tidemark_snapshots").option("path", ...)``: offsets are
snapshot ids.  Appended files are read; a ``replace`` snapshot (compaction) adds no
rows and is skipped; an ``overwrite`` fails the stream, unless it is told to skip it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .lake import read_version

NAME = "tidemark_snapshots"


def _newest(path: Path) -> dict:
    files = sorted((path / "metadata").glob("v*.json"))
    if not files:
        raise LookupError(f"no table at {path}")
    return read_version(files[-1])


class FilePart(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        out = StructType.fromJson(json.loads(_newest(Path(self.options["path"]))["schema"]))
        for f in out:
            f.nullable = True
        return out

    def streamReader(self, schema: StructType) -> SnapshotStreamReader:
        return SnapshotStreamReader(schema, self.options)


class SnapshotStreamReader(DataSourceStreamReader):
    """Options: path; start_snapshot (id already consumed, 0: none); skip_overwrites."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, Path(options["path"])
        self.start = int(options.get("start_snapshot", "0"))
        self.skip_overwrites = options.get("skip_overwrites", "false").lower() == "true"

    def initialOffset(self) -> dict:
        return {"snapshot_id": self.start}

    def latestOffset(self) -> dict:
        snapshots = _newest(self.path)["snapshots"]
        return {"snapshot_id": max([self.start, *[s["id"] for s in snapshots]])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        table = _newest(self.path)
        low, high = start["snapshot_id"], end["snapshot_id"]
        due = [s for s in table["snapshots"] if low < s["id"] <= high]
        if high > low and {s["id"] for s in due} != set(range(low + 1, high + 1)):
            raise RuntimeError(f"snapshots {low + 1} to {high} of {self.path} are needed; some have expired")
        out: list[InputPartition] = []
        for s in due:
            if s["operation"] == "append":
                out += [FilePart(str(self.path / p)) for p in s["added"]]
            elif s["operation"] != "replace" and not self.skip_overwrites:
                raise RuntimeError(f"snapshot {s['id']} of {self.path} is an {s['operation']}: the stream reads appended rows only")
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        want = to_arrow_schema(self.schema)
        for batch in pq.ParquetFile(partition.path).iter_batches():
            table = pa.Table.from_batches([batch])
            columns = [table[f.name].cast(f.type) if f.name in table.column_names else pa.nulls(len(table), f.type) for f in want]
            yield from pa.table(columns, schema=want).to_batches()

    def commit(self, end: dict) -> None:
        """The checkpoint holds the offset; nothing else to do."""
