"""Queue messages: a strict split into typed rows and rejects, and the latest per key.

A record has messageId, body and SentTimestamp (milliseconds as text).  A body is good
if it is a JSON object of known fields alone, each absent, null or of its type: text,
a whole number within 32 bits, or any number (a whole one counts as a double).  The
split is done on a VARIANT, which keeps a value's own type.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of a sensor message and their types.
FIELDS = {"event_id": "string", "station_id": "string", "observed_at": "string", "temperature_c": "double", "relative_humidity_pct": "int", "precipitation_mm": "double", "wind_speed_kmh": "double"}
RECORD = "messageId string, body string, SentTimestamp string"


def read_queue(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """A stream of records, with the number of failed tries, from a folder of JSON-lines files."""
    reader = spark.readStream.schema(RECORD + ", tries int")
    return (reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader).json(folder)


def _type_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def _fits(value: Column, kind: str) -> Column:
    """Whether a variant value is null or of a field's type."""
    found = _type_of(value)
    null = value.isNull() | F.is_variant_null(value)
    if kind == "string":
        return null | (found == "STRING")
    whole = found == "BIGINT"
    if kind == "int":
        number = F.try_variant_get(value, "$", "bigint")
        return null | (whole & number.between(-(2**31), 2**31 - 1))
    return null | whole | found.startswith("DECIMAL") | found.isin("DOUBLE", "FLOAT")


def with_problems(records: DataFrame, fields: dict[str, str] = FIELDS) -> DataFrame:
    """Adds __v (the body as a variant) and rejection_reasons."""
    df = records.withColumn("__v", F.try_parse_json("body"))
    keys = F.json_object_keys("body")
    is_object = F.coalesce(_type_of(F.col("__v")).startswith("OBJECT"), F.lit(False))
    known = F.array(*[F.lit(f) for f in fields])
    unknown = F.transform(F.array_except(keys, known), lambda x: F.concat(F.lit("unknown field "), x))
    wrong = [F.when(~_fits(F.try_variant_get("__v", f"$.{f}", "variant"), k), F.lit(f"{f} is not {k}")) for f, k in fields.items()]
    kind = F.regexp_extract(_type_of(F.col("__v")), "^[A-Z]+", 0)
    not_object = F.array(F.concat(F.lit("not a JSON object but "), F.lower(kind)))
    reasons = F.when(F.col("__v").isNull(), F.array(F.lit("not JSON"))).when(~is_object, not_object).otherwise(F.concat(unknown, F.array_compact(F.array(*wrong))))
    return df.withColumn("rejection_reasons", reasons)


def split_messages(records: DataFrame, batch_id: str | Column, ingested_at: Column, fields: dict[str, str] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): every record is on one side."""
    checked = with_problems(records, fields)
    sent = F.timestamp_millis(F.col("SentTimestamp").try_cast("bigint"))
    added = [F.col("messageId").alias("_message_id"), sent.alias("_sent_at"), (F.lit(batch_id) if isinstance(batch_id, str) else batch_id).alias("_batch_id"), ingested_at.alias("_ingested_at")]
    values = [F.try_variant_get("__v", f"$.{f}", k).alias(f) for f, k in fields.items()]
    good = F.size("rejection_reasons") == 0
    rows = checked.where(good).select(*values, *added)
    rejects = checked.where(~good).select(added[0], "body", "rejection_reasons", *added[1:])
    return rows, rejects


def latest_per_station(rows: DataFrame, at: str = "observed_at", key: str = "station_id", tiebreak: Sequence[str] = ("_sent_at", "_message_id")) -> DataFrame:
    """The newest message of each station; times without a zone, bad times and null ids don't count.

    Times are given back as ``...Z``; among equal times the first sent stays.
    """
    zoned = F.when(F.col(at).rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.regexp_replace(at, r"([+-]\d{2})(\d{2})$", "$1:$2")))
    df = rows.withColumn("__at", zoned.cast("timestamp")).where(F.col("__at").isNotNull() & F.col(key).isNotNull())
    earliest = F.struct(*[F.struct(F.col(c).isNull(), F.col(c)) for c in tiebreak if c in rows.columns], *[F.col(c) for c in sorted(rows.columns)])
    newest = df.groupBy(F.col(key).alias("__key")).agg(F.max("__at").alias("__newest"))
    found = df.join(newest, (F.col(key) == F.col("__key")) & (F.col("__at") == F.col("__newest")))
    first = found.groupBy("__key").agg(F.min_by(F.struct(*rows.columns, "__at"), earliest).alias("b"))
    return first.select("b.*").withColumn(at, F.date_format("__at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).drop("__at")
