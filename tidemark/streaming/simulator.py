"""Simulated sensors: readings of every station and minute, drawn from seeded hashes.

A draw is a hash of station, minute, seed and the draw's name, so the same call gives the
same messages on any cluster, and any part can be made again after a loss.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.config import Station, Stream

PUT_AT_ONCE = 10
_STEPS = 1 << 20


def draw(name: str, seed: int) -> Column:
    """A number from 0 to 1 (exclusive) for a row's station and minute."""
    return F.pmod(F.xxhash64("station_id", "minute", F.lit(f"{seed}/{name}")), F.lit(_STEPS)) / float(_STEPS)


def simulate(spark: SparkSession, stations: Sequence[Station], stream: Stream, first: dt.datetime, minutes: int = 1, seed: int = 0) -> DataFrame:
    """Messages with ``sent_at`` and ``copy``: a resend is copy 1 of the same event; a late one has an earlier minute."""
    sites = spark.createDataFrame([(s.station_id, float(s.latitude)) for s in stations], "station_id string, latitude double")
    start = int(first.timestamp()) // 60
    rows = sites.select("station_id", "latitude", F.explode(F.sequence(F.lit(start), F.lit(start + minutes - 1))).alias("minute"))
    late = F.when(draw("late", seed) < stream.late_rate, 1 + F.floor(draw("by", seed) * stream.max_late_minutes)).otherwise(0)
    rows = rows.withColumn("at", F.timestamp_seconds((F.col("minute") - late) * 60))
    sun = F.sin((F.hour("at") - 9) * (math.pi / 12))
    wobble = draw("w1", seed) + draw("w2", seed) + draw("w3", seed) - 1.5
    copies = F.when(draw("again", seed) < stream.duplicate_rate, 2).otherwise(1)
    return rows.select(
        F.md5(F.concat_ws("/", "station_id", F.col("minute").cast("string"), F.lit(str(seed)))).alias("event_id"),
        "station_id",
        F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observed_at"),
        F.round(24 - F.abs("latitude") / 4 + 5 * sun + 3 * wobble, 1).alias("temperature_c"),
        (35 + F.floor(60 * draw("damp", seed))).cast("int").alias("relative_humidity_pct"),
        F.when(draw("rain", seed) < 0.1, F.round(-2 * F.log(1 - draw("amount", seed)), 1)).otherwise(0.0).alias("precipitation_mm"),
        F.round(3 + 30 * F.pow(draw("wind", seed), 2), 1).alias("wind_speed_kmh"),
        F.timestamp_seconds(F.col("minute") * 60).alias("sent_at"),
        F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy"),
    )


def send(messages: DataFrame, queue: str | Path, seed: int = 0) -> None:
    """Writes records to a folder queue, ``PUT_AT_ONCE`` a file at most, in an order that isn't that of the events."""
    body = F.to_json(F.struct(*[c for c in messages.columns if c not in ("sent_at", "copy")]))
    records = messages.select(
        F.md5(F.concat_ws("/", "event_id", F.col("copy").cast("string"), F.lit(f"message {seed}"))).alias("messageId"), body.alias("body"), F.unix_millis("sent_at").cast("string").alias("SentTimestamp")
    )
    records.sortWithinPartitions("messageId").write.mode("append").option("maxRecordsPerFile", PUT_AT_ONCE).json(str(queue))
