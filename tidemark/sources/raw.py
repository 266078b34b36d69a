"""Landing raw documents and reading them with the schema that their table declares."""

from __future__ import annotations

import datetime as dt
import json
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import id_from_path
from .config import Config, Source, build_request, raw_key, raw_prefix

#: Columns that loading adds to what a document holds.
ADDED = ("station_id", "_batch_id", "_ingested_at", "_source_file")
TIMEOUT_SECONDS = 30

Fetch = Callable[[str, dict[str, str]], bytes]


def http_fetch(url: str, headers: dict[str, str]) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT_SECONDS) as r:
        return r.read()


def ingest(config: Config, source: Source, date: dt.date, landing: str | Path, fetch: Fetch = http_fetch) -> list[str]:
    """Lands the untouched body for every station; the same keys again are overwritten."""
    keys = []
    for station in config.stations:
        body = fetch(*build_request(source, station, date))
        json.loads(body)  # a body that isn't JSON never lands
        key = raw_key(source, station, date)
        path = Path(landing) / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
        keys.append(key)
    return keys


def source_schema(table: StructType) -> StructType:
    """What a document holds: the table's columns without the added ones."""
    return StructType([f for f in table if f.name not in ADDED])


def with_metadata(df: DataFrame, batch_id: str, path: Column, at: Column | None = None) -> DataFrame:
    return df.withColumns({"station_id": id_from_path(path), "_batch_id": F.lit(batch_id), "_ingested_at": F.current_timestamp() if at is None else at, "_source_file": path})


def read_documents(spark: SparkSession, schema: StructType, path: str) -> DataFrame:
    """One JSON document per file under an explicit schema; a malformed file fails."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def read_raw(spark: SparkSession, table: StructType, source: Source, date: dt.date, landing: str | Path, batch_id: str, at: Column | None = None) -> DataFrame:
    df = read_documents(spark, source_schema(table), str(Path(landing) / raw_prefix(source, date)))
    return with_metadata(df.select("*", F.col("_metadata.file_path").alias("__path")), batch_id, F.col("__path"), at).drop("__path")
