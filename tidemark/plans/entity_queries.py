"""More registered queries: the entities, messages, gold checks and the store, on the driver's tables in the entities' shapes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, daily_weather, keyed
from ..operators.rules import split, with_reasons
from ..sources.messages import latest_per_station, split_messages
from ..store import ddl, maintenance
from ..streaming.consumer import publish_latest
from .entities import MEASURES, POPULATIONS, READINGS, SENSOR_READINGS, Entity, flatten_hourly, payloads_without_rows
from .queries import _CHANGES, _KEY, ORACLES, QUERIES, _current, _lake, _orders_table, _read, _updates, query

__all__ = ["ORACLES", "QUERIES"]

_M = tuple(MEASURES)
_STAMP = "yyyy-MM-dd HH:mm:ss"


def _text(at: str | Column) -> Column:
    return F.date_format(at, _STAMP)


def _checked(entity: Entity, bronze: DataFrame) -> DataFrame:
    return with_reasons(entity.prepare(bronze), entity.rules()).withColumn("reasons", F.array_join("rejection_reasons", "|"))


# --------------------------------------------------------------- weather documents

# One document for each user and day, with parallel arrays; some have none, or one value too few, or other units.
_HOURS = """hours as (select event_id, user_id, cast(ts as date) as day, value, row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) as i,
  count(*) over (partition by user_id, cast(ts as date)) as n from events)"""
_RAW = f"""{_HOURS}, raw as (select 'u' || user_id as station_id, user_id, day,
  case when event_id % 97 = 0 then 'no time' else strftime(day + interval (i * 7 % 1440) minute, '%Y-%m-%dT%H:%M') end as observed_at_raw,
  case when event_id % 97 <> 0 then day + interval (i * 7 % 1440) minute - interval ((user_id % 5 - 2) * 1800) second end as observed_at,
  case when event_id % 11 <> 0 and not (user_id % 17 = 0 and i = n) then round(value - 60, 2) end as temperature_c, cast(event_id % 110 as integer) as relative_humidity_pct,
  round(value - 1, 2) as precipitation_mm, round(value * 2, 2) as wind_speed_kmh from hours where user_id % 19 <> 0 and user_id % 23 <> 0)"""
_RANGES = "".join(
    f", case when {n} is null then 'missing_{n}' end, case when not {n} between {low} and {high} then 'out_of_range_{n}' end"
    for n, low, high in (("temperature_c", -90, 60), ("relative_humidity_pct", 0, 100), ("precipitation_mm", 0, 500), ("wind_speed_kmh", 0, 500))
)
_WEATHER = f"""{_RAW}, weather as (select *, array_to_string(list_filter([case when observed_at is null then 'invalid_observed_at' end, case when user_id % 17 = 0 then 'array_lengths_differ' end{_RANGES},
  case when user_id % 13 = 0 then 'unexpected_unit_temperature_c' end], lambda x: x is not null), '|') as reasons from raw)"""


def _weather_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.struct("ts", "event_id", "value").alias("e"))
    docs = events.groupBy("user_id", "day").agg(F.sort_array(F.collect_list("e")).alias("e"))
    minute = F.transform("e", lambda x, i: F.when(x["event_id"] % 97 == 0, "no time").otherwise(F.date_format(F.timestamp_seconds(F.unix_date("day").cast("long") * 86400 + (i + 1) * 7 % 1440 * 60), "yyyy-MM-dd'T'HH:mm")))
    warm = F.transform("e", lambda x: F.when(x["event_id"] % 11 != 0, F.round(x["value"] - 60, 2)))
    arrays = F.struct(
        minute.alias("time"),
        F.when(F.col("user_id") % 17 == 0, F.slice(warm, 1, F.size("e") - 1)).otherwise(warm).alias("temperature_2m"),
        F.transform("e", lambda x: (x["event_id"] % 110).cast("int")).alias("relative_humidity_2m"),
        F.transform("e", lambda x: F.round(x["value"] - 1, 2)).alias("precipitation"),
        F.transform("e", lambda x: F.round(x["value"] * 2, 2)).alias("wind_speed_10m"),
    )
    none = F.expr("cast(array() as array<string>)")
    time = F.when(F.col("user_id") % 23 == 0, F.lit(None)).when(F.col("user_id") % 19 == 0, none).otherwise(F.col("hourly.time"))
    degrees = F.when(F.col("user_id") % 13 == 0, "°F").otherwise("°C")
    units = F.struct(F.lit("iso8601").alias("time"), degrees.alias("temperature_2m"), F.lit("%").alias("relative_humidity_2m"), F.lit("mm").alias("precipitation"), F.lit("km/h").alias("wind_speed_10m"))
    docs = docs.select(F.concat(F.lit("u"), "user_id").alias("station_id"), "user_id", "day", arrays.alias("hourly"), units.alias("hourly_units"))
    return docs.select(
        "station_id",
        ((F.col("user_id") % 5 - 2) * 1800).cast("int").alias("utc_offset_seconds"),
        F.col("hourly").withField("time", time).alias("hourly"),
        "hourly_units",
        F.col("day").cast("string").alias("_batch_id"),
        F.col("day").cast("timestamp").alias("_ingested_at"),
        F.concat(F.lit("/"), "station_id", F.lit(".json")).alias("_source_file"),
    )


@query(f"with {_RAW} select station_id, observed_at_raw, {', '.join(_M)} from raw")
def hourly_flattened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_hourly(_weather_documents(spark, sf_dir)).select("station_id", "observed_at_raw", *_M)


@query("select count(*) as n from (select distinct user_id, cast(ts as date) from events where user_id % 19 = 0 or user_id % 23 = 0)")
def documents_without_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(payloads_without_rows(_weather_documents(spark, sf_dir)),)], "n long")


@query(f"with {_WEATHER} select station_id, observed_at_raw, strftime(observed_at, '%Y-%m-%d %H:%M:%S') as observed_at, reasons from weather")
def weather_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local times to UTC, and every rule of the readings."""
    return _checked(READINGS, _weather_documents(spark, sf_dir)).select("station_id", "observed_at_raw", _text("observed_at").alias("observed_at"), "reasons")


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = split(with_reasons(READINGS.prepare(_weather_documents(spark, sf_dir)), READINGS.rules()))
    return keyed.dedup_latest(valid, READINGS.key, READINGS.prefer(), tiebreak=READINGS.tiebreak)


def _valid_sql(columns: str, where: str = "reasons = ''") -> str:
    return f"select {columns} from (select *, row_number() over (partition by station_id, observed_at order by day desc) as k from weather where {where}) where k = 1"


@query(f"with {_WEATHER} {_valid_sql('station_id, observed_at, ' + ', '.join(_M)).replace('observed_at, temp', 'strftime(observed_at, chr(37) || $$Y-%m-%d %H:%M:%S$$) as observed_at, temp')}")
def readings_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid readings, one for each station and minute."""
    return _readings(spark, sf_dir).select("station_id", _text("observed_at").alias("observed_at"), *_M)


# --------------------------------------------------------------- population statements

_STATEMENTS = """statements as (select 'n' || c_nationkey as station_id, c_custkey as k,
  case c_custkey % 7 when 0 then c_custkey || '.5' when 1 then 'lots' when 2 then '-5' when 3 then null when 4 then repeat('9', 30) else cast(c_custkey + 1 as varchar) end as population_raw,
  case when c_custkey % 5 = 0 then null when c_custkey % 11 = 0 then 'when' else strftime(date '2020-01-01' + cast(c_custkey % 400 as integer), '%Y-%m-%d') || 'T00:00:00Z' end as point_in_time_raw,
  case when c_custkey % 13 = 0 then 'http://x#DeprecatedRank' when c_custkey % 3 = 0 then 'http://x#PreferredRank' else 'http://x#NormalRank' end as rank_raw from customer),
  numbers as (select *, case when c % 5 = 0 or c % 11 = 0 then null else date '2020-01-01' + cast(c % 400 as integer) end as reference_date,
    case when c % 7 in (5, 6) then c + 1 when c % 7 = 2 then -5 end as population from (select *, k as c from statements)),
  population as (select *, array_to_string(list_filter([case when point_in_time_raw is null then 'missing_point_in_time' end, case when point_in_time_raw = 'when' then 'invalid_point_in_time' end,
    case when population_raw is null then 'missing_population' end, case when k % 7 in (1, 4) then 'invalid_population' end, case when k % 7 = 2 then 'non_positive_population' end,
    case when k % 7 = 0 then 'fractional_population' end, case when rank_raw like '%DeprecatedRank' then 'deprecated_rank' end], lambda x: x is not null), '|') as reasons from numbers)"""


def _population_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    number = F.expr("case c_custkey % 7 when 0 then concat(c_custkey, '.5') when 1 then 'lots' when 2 then '-5' when 3 then null when 4 then repeat('9', 30) else cast(c_custkey + 1 as string) end")
    day = F.expr("case when c_custkey % 5 = 0 then null when c_custkey % 11 = 0 then 'when' else concat(cast(date_add(date'2020-01-01', cast(c_custkey % 400 as int)) as string), 'T00:00:00Z') end")
    rank = F.when(k % 13 == 0, "http://x#DeprecatedRank").when(k % 3 == 0, "http://x#PreferredRank").otherwise("http://x#NormalRank")
    value = lambda c: F.struct(c.alias("value"))
    rows = _read(spark, sf_dir, "customer").select("c_nationkey", F.struct(value(number).alias("population"), value(day).alias("point_in_time"), value(rank).alias("rank")).alias("b"))
    docs = rows.groupBy("c_nationkey").agg(F.collect_list("b").alias("bindings"))
    return docs.select(
        F.struct("bindings").alias("results"), F.concat(F.lit("n"), "c_nationkey").alias("station_id"), F.lit("b1").alias("_batch_id"), F.lit("/x.json").alias("_source_file"), F.lit("2024-01-01").cast("timestamp").alias("_ingested_at")
    )


@query(f"with {_STATEMENTS} select station_id, population_raw, point_in_time_raw, rank_raw, cast(reference_date as varchar) as reference_date, cast(population as bigint) as population, reasons from population")
def population_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements flattened from their documents, with every rule."""
    return _checked(POPULATIONS, _population_documents(spark, sf_dir)).select("station_id", "population_raw", "point_in_time_raw", "rank_raw", F.col("reference_date").cast("string").alias("reference_date"), "population", "reasons")


_POPULATIONS = f"{_STATEMENTS}, best as (select *, row_number() over (partition by station_id, reference_date order by (rank_raw like '%PreferredRank') desc, population desc) as r from population where reasons = '')"


@query(f"with {_POPULATIONS} select station_id, cast(reference_date as varchar) as reference_date, cast(population as bigint) as population, rank_raw like '%PreferredRank' as is_preferred_rank from best where r = 1")
def populations_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid statements; the preferred one of a station and date wins."""
    valid, _ = split(with_reasons(POPULATIONS.prepare(_population_documents(spark, sf_dir)), POPULATIONS.rules()))
    best = keyed.dedup_latest(valid, POPULATIONS.key, POPULATIONS.prefer(), tiebreak=POPULATIONS.tiebreak)
    return best.select("station_id", F.col("reference_date").cast("string").alias("reference_date"), "population", "is_preferred_rank")


# --------------------------------------------------------------- queue messages

# Bodies of every kind: good ones, no JSON, an unknown field, numbers and texts of the wrong type, late and zoneless times.
_MESSAGES = """messages as (select event_id, user_id, ts, 'm' || event_id as message_id, event_id % 11 as kind, round(value, 2) as v,
  case when event_id % 11 = 5 then null when event_id % 11 = 6 then strftime(ts, '%Y-%m-%dT%H:%M:%S') else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as said from events)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 11
    at = F.when(kind == 5, F.lit(None)).when(kind == 6, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.concat(F.lit("u"), "user_id").alias("station_id"), at.alias("observed_at"), F.round("value", 2).alias("temperature_c"), (F.col("event_id") % 110).cast("int").alias("relative_humidity_pct")))
    open_ = F.regexp_replace(body, r"\}$", "")
    body = (
        F.when(kind == 0, "{no json").when(kind == 1, F.concat(open_, F.lit(', "extra": 1}'))).when(kind == 2, F.concat(open_, F.lit(', "wind_speed_kmh": "fast"}')))
        .when(kind == 3, F.concat(open_, F.lit(', "precipitation_mm": 2}'))).when(kind == 4, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    )
    return _read(spark, sf_dir, "events").select(F.concat(F.lit("m"), "event_id").alias("messageId"), body.alias("body"), F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("SentTimestamp"))


@query(f"with {_MESSAGES} select message_id, cast(event_id as varchar) as event_id, 'u' || user_id as station_id, said as observed_at, v as temperature_c, cast(event_id % 110 as integer) as relative_humidity_pct, case when kind = 3 then 2.0::double end as precipitation_mm, epoch_us(ts) // 1000 as sent from messages where kind not in (0, 1, 2, 4)")
def message_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The good side of the strict split."""
    rows, _ = split_messages(_records(spark, sf_dir), "b", F.lit(None).cast("timestamp"))
    return rows.select(F.col("_message_id").alias("message_id"), "event_id", "station_id", "observed_at", "temperature_c", "relative_humidity_pct", "precipitation_mm", F.unix_millis("_sent_at").alias("sent"))


@query(f"with {_MESSAGES} select message_id, case kind when 0 then 'not JSON' when 1 then 'unknown field extra' when 2 then 'wind_speed_kmh is not double' else 'not a JSON object but array' end as reasons from messages where kind in (0, 1, 2, 4)")
def message_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = split_messages(_records(spark, sf_dir), "b", F.lit(None).cast("timestamp"))
    return rejects.select(F.col("_message_id").alias("message_id"), F.array_join("rejection_reasons", "|").alias("reasons"))


@query(f"with {_MESSAGES} select 'u' || user_id as station_id, max(said) as observed_at, min_by(message_id, (epoch_us(ts) // 1000, message_id)) filter (where said = top) as message_id from (select *, max(said) over (partition by user_id) as top from messages where kind in (3, 7, 8, 9, 10)) group by user_id")
def latest_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest message of each station by its own time; among equal times the first sent."""
    rows, _ = split_messages(_records(spark, sf_dir), "b", F.lit(None).cast("timestamp"))
    return latest_per_station(rows).select("station_id", "observed_at", F.col("_message_id").alias("message_id"))


@query(f"with {_MESSAGES}, s as (select *, cast(event_id % 110 as integer) as h from messages where kind not in (0, 1, 2, 4)) select message_id, array_to_string(list_filter([case when kind in (5) then 'invalid_observed_at' when kind = 6 then 'invalid_observed_at' end, case when not v between -90 and 60 then 'out_of_range_temperature_c' end, case when h > 100 then 'out_of_range_relative_humidity_pct' end, case when kind <> 3 then 'missing_precipitation_mm' end, 'missing_wind_speed_kmh'], lambda x: x is not null), '|') as reasons from s")
def sensor_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = split_messages(_records(spark, sf_dir), "b", F.lit(None).cast("timestamp"))
    return _checked(SENSOR_READINGS, rows).select(F.col("_message_id").alias("message_id"), "reasons")


# --------------------------------------------------------------- gold

# The populations of the gold table: each station's, by the last digits of its name.
_GOLD = f"""{_WEATHER}, silver as ({_valid_sql('*')}), days as (select station_id, cast(observed_at as date) as reading_date, cast(count(*) as integer) as hours_observed, min(temperature_c) as lo, max(temperature_c) as hi,
    avg(temperature_c) as mid, avg(relative_humidity_pct) as humid, sum(precipitation_mm) as rain, max(wind_speed_kmh) as wind from silver group by 1, 2),
  trends as (select *, avg(mid) over (partition by station_id order by reading_date range between interval 6 days preceding and current row) as mid7,
    case when lag(reading_date) over w + 1 = reading_date then mid - lag(mid) over w end as change from days window w as (partition by station_id order by reading_date)),
  people as (select distinct station_id, date '2024-01-05' as at, cast(substr(station_id, 2) as bigint) * 1000 as population from silver where cast(substr(station_id, 2) as bigint) % 2 = 0),
  gold as (select t.*, p.population, p.at as population_date from trends t asof left join people p on t.station_id = p.station_id and t.reading_date >= p.at)"""


def _gold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    silver = _readings(spark, sf_dir)
    number = F.substring("station_id", 2, 20).cast("long")
    people = silver.select("station_id").distinct().where(number % 2 == 0).select("station_id", F.lit("2024-01-05").cast("date").alias("reference_date"), (number * 1000).alias("population"))
    return daily_weather.build(silver, people), silver


@query(
    f"""with {_GOLD} select station_id, cast(reading_date as varchar) as reading_date, hours_observed, hours_observed = 24 as is_complete_day, lo as temperature_min_c, hi as temperature_max_c, round(mid, 6) as temperature_avg_c,
  round(mid7, 6) as temperature_avg_7d_c, round(change, 6) as temperature_change_c, round(humid, 6) as relative_humidity_avg_pct, round(rain, 6) as precipitation_total_mm, wind as wind_speed_max_kmh, population,
  cast(population_date as varchar) as population_reference_date from gold"""
)
def daily_weather_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, _ = _gold(spark, sf_dir)
    rounded = {c: F.round(c, 6) for c in ("temperature_avg_c", "temperature_avg_7d_c", "temperature_change_c", "relative_humidity_avg_pct", "precipitation_total_mm")}
    return gold.drop("_built_at").withColumns(rounded | {c: F.col(c).cast("string") for c in ("reading_date", "population_reference_date")})


@query(
    f"""with {_GOLD}, g as (select count(*) as n, count(distinct (station_id, reading_date)) as keys, count(*) filter (where mid is null or humid is null or rain is null or wind is null) as nulls,
    count(*) filter (where not hours_observed between 1 and 24) as hours, count(*) filter (where not (lo <= mid + 1e-9 and mid <= hi + 1e-9)) as disorder, count(*) filter (where population is null) as nobody,
    sum(hours_observed) as total, sum(rain) as rain from gold), s as (select count(*) as n, sum(precipitation_mm) as rain from silver)
  select unnest(['not_empty', 'unique_key', 'required_not_null', 'hours_in_range', 'temperature_order', 'population_found', 'hours_reconcile', 'precipitation_reconciles']) as name,
    unnest([g.n > 0, g.n = g.keys, g.nulls = 0, g.hours = 0, g.disorder = 0, g.nobody = 0, g.total = s.n, abs(g.rain - s.rain) < 1e-6]) as passed from g, s"""
)
def eight_gold_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, silver = _gold(spark, sf_dir)
    found = checks.daily_weather_checks(gold, silver, daily_weather.REQUIRED)
    return spark.createDataFrame([(c.name, bool(c.passed)) for c in found], "name string, passed boolean")


@query("select * from (select 'same rows in another order' as pair, exists (select * from orders except all select * from orders) as differ) union all select 'one price higher', exists (select * replace (case when o_orderkey = 7 then o_totalprice + 1 else o_totalprice end as o_totalprice) from orders except all select * from orders) union all select 'a row twice', exists ((select * from orders union all select * from orders where o_orderkey = 7) except all select * from orders)")
def rows_differ(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multiset comparison that decides whether the gold table is published."""
    orders = _read(spark, sf_dir, "orders")
    higher = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    pairs = {"same rows in another order": orders.orderBy(F.desc("o_orderkey")), "one price higher": higher, "a row twice": orders.unionAll(orders.where("o_orderkey = 7"))}
    return spark.createDataFrame([(k, keyed.differs(df, orders)) for k, df in pairs.items()], "pair string, differ boolean")


# --------------------------------------------------------------- the table store


@query(f"with {_CHANGES} select * from upd")
def store_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, orders = _orders_table(spark, sf_dir)
    table.overwrite(_updates(orders))
    return table.read()


@query("select * from orders where o_orderkey % 3 <> 0")
def read_as_of_a_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, orders = _orders_table(spark, sf_dir)
    first = dt.datetime.fromisoformat(table.snapshot()["committed_at"])
    table.overwrite(_updates(orders))
    return table.read(as_of=first)


@query("with c as (select distinct nullif(o_custkey, 10) as cust from orders) select cust from c")
def store_insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers inserted where they aren't stored yet, null equal to null; then again, which adds nothing."""
    orders = _read(spark, sf_dir, "orders")
    rows = orders.select(F.nullif("o_custkey", F.lit(10)).alias("cust"))
    table = _lake(spark).create("ops", "customers", rows.schema)
    table.append(rows.where("cust % 2 = 0").distinct())
    table.insert_new(rows, ["cust"])
    table.insert_new(rows, ["cust"])
    return table.read()


@query(f"with {_CHANGES} select c.* replace (coalesce(u.o_totalprice, c.o_totalprice) as o_totalprice) from cur c left join upd u using (o_orderkey) union all select * from upd where o_orderkey % 3 = 0")
def merge_some_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge that sets one column of matched rows and inserts the others whole."""
    table, orders = _orders_table(spark, sf_dir)
    table.merge(_updates(orders), _KEY, set_columns=["o_totalprice"])
    return table.read()


@query("select 'u' || user_id as station_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') as observed_at from events where user_id is not null group by 1")
def latest_is_never_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional puts of the later half of the events first: what comes later and is older moves nothing."""
    events = _read(spark, sf_dir, "events").where("user_id is not null").select(F.concat(F.lit("u"), "user_id").alias("station_id"), F.col("ts").cast("timestamp").alias("observed_at"), "value", "event_id")
    lake = _lake(spark)
    table = lake.create("ops", "latest", events.select("station_id", "observed_at", "value").schema)
    for part in ("event_id % 2 = 1", "event_id % 2 = 0 or event_id is null", "event_id % 2 = 1"):
        publish_latest(lake, "ops", "latest", keyed.latest_per_key(events.where(part), "station_id", "observed_at", ["event_id"]))
    return table.read().select("station_id", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("observed_at"))


@query("with y as (select year(o_orderdate) as y, count(*) as n from orders group by 1) select cast(y as varchar) as year, n, 1 as snapshots from y")
def expiry_keeps_the_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each year after compaction, expiry of all snapshots but one, and removal of orphans."""
    table, orders = _orders_table(spark, sf_dir)
    table.append(orders.where("o_orderkey % 3 = 0"))
    options = maintenance.Options(expire_days=0, retain_last=1, orphan_days=1, rewrite_all=True)
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(days=2)
    maintenance.maintain(table.lake, options, current=later)
    n = len(table.load().snapshots)
    return table.read().groupBy(F.year("o_orderdate").cast("string").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.lit(n).alias("snapshots"))


@query("select cast(date_trunc('year', o_orderdate) as varchar)[:4] as year, count(*) as n from orders where o_orderkey % 3 <> 0 group by 1")
def files_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata tables of files and partitions."""
    table, _ = _orders_table(spark, sf_dir)
    files = table.files_df().groupBy("partition").agg(F.sum("record_count").alias("n"))
    return files.join(table.partitions_df().select("partition", F.col("record_count").alias("m")), "partition").where("n = m").select(F.substring("partition", 1, 4).alias("year"), "n")


@query("select * from (select 1 as id, 'append' as operation, count(*) filter (where o_orderkey % 3 <> 0) as added, 0 as deleted from orders union all select 2, 'overwrite', count(*) filter (where o_orderkey % 2 = 0), count(*) filter (where o_orderkey % 3 <> 0) from orders)")
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, orders = _orders_table(spark, sf_dir)
    table.overwrite(_updates(orders))
    s = table.snapshots_df()
    return s.select(F.col("snapshot_id").cast("int").alias("id"), "operation", F.col("summary")["added-records"].cast("long").alias("added"), F.col("summary")["deleted-records"].cast("long").alias("deleted"))


@query("select *, case when o_orderkey % 2 = 1 then o_custkey % 7 end as region from orders")
def column_added_by_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DDL: a table made by CREATE, a column added and a partition field replaced between two appends."""
    orders = _read(spark, sf_dir, "orders")
    lake = _lake(spark)
    columns = ", ".join(f"{n} {t}" for n, t in orders.dtypes)
    ddl.execute(lake, f"CREATE TABLE ops.shop ({columns}) PARTITIONED BY (years(o_orderdate))")
    table = lake.table("ops", "shop")
    table.append(orders.where("o_orderkey % 2 = 0"))
    ddl.execute(lake, "ALTER TABLE ops.shop ADD COLUMN region BIGINT")
    ddl.execute(lake, "ALTER TABLE ops.shop REPLACE PARTITION FIELD years(o_orderdate) WITH months(o_orderdate)")
    ddl.execute(lake, "ALTER TABLE ops.shop WRITE ORDERED BY o_orderkey")
    table.append(orders.where("o_orderkey % 2 = 1").withColumn("region", F.col("o_custkey") % 7))
    return table.read()


@query("select o_orderkey, o_totalprice from orders where o_orderkey % 3 <> 0 order by o_totalprice desc, o_orderkey limit 20")
def analyst_query_in_the_past(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over an earlier snapshot: a top-k report."""
    table, orders = _orders_table(spark, sf_dir)
    table.overwrite(_updates(orders))
    return table.lake.sql("select o_orderkey, o_totalprice from ops.orders version as of 1 order by o_totalprice desc, o_orderkey limit 20")
