"""Registered queries: each operator on the driver's tables, with the same thing in DuckDB SQL."""

from __future__ import annotations

import datetime as dt
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calendar, checks, contract, keyed
from ..operators.rules import Rule, missing, outside, split, with_reasons
from ..operators.secure import secure_view
from ..sources.messages import with_problems
from ..store.lake import Lake, Table
from ..store.maintenance import Options, compact
from ..store.stream_source import NAME, SnapshotSource

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --------------------------------------------------------------- aggregates, windows, joins

_DAILY = """select user_id, cast(ts as date) as day, cast(count(*) as integer) as n, min(value) as v_min, max(value) as v_max, avg(value) as v_avg, sum(value) as v_sum,
  count(*) = 24 as is_complete from events group by 1, 2"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = {"v_min": F.min("value"), "v_max": F.max("value"), "v_avg": F.avg("value"), "v_sum": F.sum("value")}
    return calendar.daily(_read(spark, sf_dir, "events"), ["user_id"], "ts", v, complete_at=24)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"select * replace (round(v_avg, 6) as v_avg, round(v_sum, 6) as v_sum) from ({_DAILY})")
def daily_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_daily(spark, sf_dir), "v_avg", "v_sum")


@query(
    f"""with d as ({_DAILY}) select user_id, day, round(avg(v_max) over (partition by user_id order by day range between interval 6 days preceding and current row), 6) as v_max_7d,
  case when lag(day) over (partition by user_id order by day) + 1 = day then round(v_max - lag(v_max) over (partition by user_id order by day), 6) end as v_max_change from d"""
)
def calendar_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _daily(spark, sf_dir)
    return _rounded(d.select("user_id", "day", calendar.rolling_mean(["user_id"], "day", "v_max").alias("v_max_7d"), calendar.change_from_yesterday(["user_id"], "day", "v_max").alias("v_max_change")), "v_max_7d", "v_max_change")


def _purchase_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = _read(spark, sf_dir, "events")
    left = events.select("user_id", F.to_date("ts").alias("day")).distinct()
    right = events.where("event_type = 'purchase'").groupBy("user_id", F.to_date("ts").alias("rd")).agg(F.count(F.lit(1)).alias("n"))
    return left, right


_SIDES = """l as (select distinct user_id, cast(ts as date) as day from events),
  r as (select user_id, cast(ts as date) as rd, count(*) as n from events where event_type = 'purchase' group by 1, 2)"""


@query(f"with {_SIDES} select l.user_id, l.day, r.n as purchases, r.rd as purchase_day from l asof left join r on l.user_id = r.user_id and l.day >= r.rd")
def asof_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _purchase_days(spark, sf_dir)
    return calendar.as_of(left, right, ["user_id"], "day", "rd", {"n": "purchases", "rd": "purchase_day"})


@query(f"with {_SIDES} select l.user_id, l.day, max_by(r.n, r.rd) as purchases from l left join r on l.user_id = r.user_id and r.rd <= l.day group by 1, 2")
def asof_max_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _purchase_days(spark, sf_dir)
    return calendar.as_of_max_by(left, right, ["user_id"], "day", "rd", "n", "purchases")


@query(f"with {_SIDES} select l.user_id, l.day, count(r.rd) as earlier from l left join r on l.user_id = r.user_id and r.rd <= l.day group by 1, 2")
def theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _purchase_days(spark, sf_dir)
    r = right.select(F.col("user_id").alias("u"), "rd")
    return left.join(r, (F.col("user_id") == F.col("u")) & (F.col("rd") <= F.col("day")), "left").groupBy("user_id", "day").agg(F.count("rd").alias("earlier"))


_FLAGSHIP = f"""with d as ({_DAILY}), {_SIDES},
  t as (select *, avg(v_max) over (partition by user_id order by day range between interval 6 days preceding and current row) as m,
    lag(day) over (partition by user_id order by day) as ld, lag(v_max) over (partition by user_id order by day) as lv from d)
  select t.user_id, t.day, t.n, t.v_min, t.v_max, t.is_complete, round(m, 6) as v_max_7d, case when ld + 1 = t.day then round(t.v_max - lv, 6) end as v_max_change, r.n as purchases, r.rd as purchase_day
  from t asof left join r on t.user_id = r.user_id and t.day >= r.rd"""


@query(_FLAGSHIP)
def gold_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily aggregate, calendar trends and an as-of reference: the shape of the gold table."""
    d = _daily(spark, sf_dir).drop("v_avg", "v_sum")
    d = d.withColumns({"v_max_7d": calendar.rolling_mean(["user_id"], "day", "v_max"), "v_max_change": calendar.change_from_yesterday(["user_id"], "day", "v_max")})
    _, right = _purchase_days(spark, sf_dir)
    return _rounded(calendar.as_of(d, right, ["user_id"], "day", "rd", {"n": "purchases", "rd": "purchase_day"}), "v_max_7d", "v_max_change")


# --------------------------------------------------------------- keyed mechanics


@query(
    """select * exclude (k) from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc nulls last, l_partkey desc nulls last, l_suppkey desc nulls last,
  l_quantity desc nulls last, l_extendedprice desc nulls last, l_discount desc nulls last, l_tax desc nulls last, l_returnflag desc nulls last, l_linestatus desc nulls last) as k from lineitem) where k = 1"""
)
def dedup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return keyed.dedup_latest(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], at="l_shipdate", tiebreak=rest)


def _current(orders: DataFrame) -> DataFrame:
    return orders.where("o_orderkey % 3 <> 0")


def _updates(orders: DataFrame) -> DataFrame:
    return orders.where("o_orderkey % 2 = 0").withColumns(
        {
            "o_totalprice": F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")),
            "o_orderstatus": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")),
            "o_orderdate": F.when(F.col("o_orderkey") % 10 == 0, F.expr("o_orderdate - interval 1 day")).otherwise(F.col("o_orderdate")),
        }
    )


_KEY, _VALUES, _AT = ["o_orderkey"], ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"], "o_orderdate"
_CHANGES = """cur as (select * from orders where o_orderkey % 3 <> 0),
  upd as (select * replace (case when o_orderkey % 5 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice, case when o_orderkey % 7 <> 0 then o_orderstatus end as o_orderstatus,
    case when o_orderkey % 10 = 0 then o_orderdate - interval 1 day else o_orderdate end as o_orderdate) from orders where o_orderkey % 2 = 0),
  cls as (select u.*, case when c.o_orderkey is null then 'new' when u.o_orderdate >= c.o_orderdate and (u.o_custkey is distinct from c.o_custkey or u.o_orderstatus is distinct from c.o_orderstatus
    or u.o_totalprice is distinct from c.o_totalprice or u.o_orderpriority is distinct from c.o_orderpriority) then 'changed' else 'unchanged' end as change from upd u left join cur c using (o_orderkey))"""


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    return keyed.classify(_updates(orders), _current(orders), _KEY, _VALUES, _AT)


@query(f"with {_CHANGES} select * from cls")
def classify_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir)


@query(f"with {_CHANGES} select change, count(*) as n from cls group by change")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_CHANGES} select * exclude (change) from cls where change <> 'unchanged'")
def rows_to_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.to_merge(_classified(spark, sf_dir))


_MERGED = f"with {_CHANGES}, win as (select * exclude (change) from cls where change <> 'unchanged') select * from win union all select * from cur where o_orderkey not in (select o_orderkey from win)"


@query(_MERGED)
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    return keyed.upsert(_current(orders), _updates(orders), _KEY, _VALUES, _AT)


@query("select o_orderkey, nullif(o_custkey, 10) as cust from orders o where not exists (select 1 from orders s where s.o_orderkey % 3 <> 0 and nullif(s.o_custkey, 10) is not distinct from nullif(o.o_custkey, 10))")
def null_safe_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders against the stored ones."""
    orders = _read(spark, sf_dir, "orders")
    customer = F.nullif("o_custkey", F.lit(10))
    stored = _current(orders).select(customer.alias("known"))
    return orders.select("o_orderkey", customer.alias("cust")).join(stored, F.col("cust").eqNullSafe(F.col("known")), "left_anti")


@query("select min(o_orderkey) as o_orderkey, nullif(o_custkey, 10) as cust from orders o where not exists (select 1 from orders s where s.o_orderkey % 3 <> 0 and nullif(s.o_custkey, 10) is not distinct from nullif(o.o_custkey, 10)) group by 2")
def insert_new_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as rejects, of which the stored ones are known."""
    orders = _read(spark, sf_dir, "orders")
    columns = ["o_orderkey", F.nullif("o_custkey", F.lit(10)).alias("cust")]
    return keyed.new_rejects(orders.select(*columns), _current(orders).select(*columns), ["cust"], [F.col("o_orderkey")])


@query("select * from orders except all select * from orders where o_orderkey % 2 = 0")
def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    return orders.exceptAll(orders.where("o_orderkey % 2 = 0"))


@query("select * exclude (k) from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events where user_id is not null and ts is not null) where k = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.latest_per_key(_read(spark, sf_dir, "events"), "user_id", "ts", ["event_id"])


@query("select cast(min(ts) as varchar)[:19] as low, cast(max(ts) as varchar)[:19] as high, count(*) as n from events where event_type = 'click'")
def batch_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal bounds of a batch, used to read the table within them."""
    events = _read(spark, sf_dir, "events")
    limits = keyed.bounds(events.where("event_type = 'click'"), "ts")
    inside = events.where(keyed.within("ts", limits)).where("event_type = 'click'")
    return inside.agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("low"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("high"), F.count(F.lit(1)).alias("n"))


@query(f"with {_CHANGES} select change, count(*) as n from cls where o_orderdate between timestamp '1996-01-01' and timestamp '1996-12-31' group by change")
def bounded_equals_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of one range of keys classified against the stored rows of that range alone."""
    orders = _read(spark, sf_dir, "orders")
    batch = _updates(orders).where("o_orderdate between timestamp_ntz '1996-01-01' and timestamp_ntz '1996-12-31'")
    limits = keyed.bounds(batch, "o_orderkey")
    stored = _current(orders).where(keyed.within("o_orderkey", limits))
    return keyed.classify(batch, stored, _KEY, _VALUES, _AT).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------- rules, checks, contract


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("value"), "event_type")


def _with_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [missing("user_id"), missing("value"), outside("value", 5, 80), Rule("is_error", F.col("event_type") == "error")]
    return with_reasons(_dirty(spark, sf_dir), rules)


_DIRTY = "select event_id, case when event_id % 11 <> 0 then user_id end as user_id, case when event_id % 13 <> 0 then value end as value, event_type from events"
_REASONS = f"""select *, list_filter([case when user_id is null then 'missing_user_id' end, case when value is null then 'missing_value' end,
  case when not value between 5 and 80 then 'out_of_range_value' end, case when event_type = 'error' then 'is_error' end], lambda x: x is not null) as r from ({_DIRTY})"""


@query(f"select event_id, user_id, value, event_type, coalesce(array_to_string(r, '|'), '') as reasons from ({_REASONS})")
def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_rules(spark, sf_dir).select("event_id", "user_id", "value", "event_type", F.array_join("rejection_reasons", "|").alias("reasons"))


@query(f"select len(r) = 0 as is_valid, count(*) as n from ({_REASONS}) group by 1")
def valid_rejected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, rejected = split(_with_rules(spark, sf_dir))
    return valid.select(F.lit(True).alias("is_valid")).unionAll(rejected.select(F.lit(False).alias("is_valid"))).groupBy("is_valid").agg(F.count(F.lit(1)).alias("n"))


@query(f"select count(*) as input, count(*) filter (len(r) = 0) as valid, count(*) filter (len(r) > 0) as rejected, count(distinct case when len(r) = 0 then user_id end) as unique_keys from ({_REASONS})")
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = keyed.split_counts(_with_rules(spark, sf_dir), ["user_id"])
    return spark.createDataFrame([(c["input"], c["valid"], c["rejected"], c["unique"])], "input long, valid long, rejected long, unique_keys long")


@query(
    """select count(*) as rows, count(distinct (l_orderkey, l_linenumber)) as keys, cast(count_if(l_shipdate is null) as bigint) as nulls, cast(count_if(not l_quantity between 1 and 40) as bigint) as big,
  round(coalesce(sum(l_quantity), 0), 4) as quantity from lineitem"""
)
def gold_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = {"nulls": F.col("l_shipdate").isNull(), "big": ~F.col("l_quantity").between(1, 40)}
    m = checks.measure_table(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], conditions, {"quantity": "l_quantity"})
    return spark.createDataFrame([(m["rows"], m["keys"], m["nulls"], m["big"], round(m["quantity"], 4))], "rows long, keys long, nulls long, big long, quantity double")


@query(
    """with t as (select column_name as c, lower(column_type) as k from (describe orders)),
  w as (select case c when 'o_totalprice' then 'price' else c end as c, case c when 'o_orderkey' then 'string' else k end as k from t)
  select 'missing column ' || c || ' (' || k || ')' as problem from t anti join w using (c) union all select 'extra column ' || c || ' (' || k || ')' from w anti join t using (c)
  union all select 'column ' || c || ' is ' || w.k || ', the table has ' || t.k from w join t using (c) where w.k <> t.k"""
)
def schema_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders")
    written = orders.withColumnRenamed("o_totalprice", "price").withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    return spark.createDataFrame([(p,) for p in contract.mismatches(written.dtypes, orders.dtypes)], "problem string")


@query("select * exclude (value, props) from events where event_type in ('click', 'view') and value > 10")
def secure_view_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secure_view(_read(spark, sf_dir, "events"), "event_type in ('click', 'view') and value > 10", ["value", "props"])


# --------------------------------------------------------------- nested data and text


@query("select vec_id, i - 1 as pos, cast(embedding[i] as double) as x from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)")
def posexplode_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.posexplode("embedding").alias("pos", "v"))
    return e.select("vec_id", F.col("pos").cast("long").alias("pos"), F.get("embedding", F.col("pos")).cast("double").alias("x"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("select event_id, case when event_id % 9 <> 0 then date_trunc('minute', ts) end as at from events")
def try_parse_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_id") % 9 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).otherwise("not-a-time")
    return _read(spark, sf_dir, "events").select("event_id", F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm")).cast("timestamp_ntz").alias("at"))


@query(
    """select event_id, case event_id % 5 when 0 then 'not JSON' when 1 then 'not a JSON object but array' when 2 then 'unknown field b' when 3 then 'k is not int' else '' end as problems from events"""
)
def strict_json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.expr("case event_id % 5 when 0 then 'not json' when 1 then concat('[', props, ']') when 2 then concat(rtrim('}', props), ', \"b\": 1}') when 3 then '{\"k\": 1.5}' else props end")
    records = _read(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return with_problems(records, {"k": "int"}).select("event_id", F.array_join("rejection_reasons", "|").alias("problems"))


# --------------------------------------------------------------- the table store


def _lake(spark: SparkSession) -> Lake:
    """A store in the shared folder that the cluster names, or in the warehouse where it names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    if not shared.startswith(("/", "file:")):
        raise ValueError(f"the table store needs a shared POSIX folder, not {shared}")
    base = Path("/" + shared.removeprefix("file:").lstrip("/"))
    base.mkdir(parents=True, exist_ok=True)
    return Lake(spark, tempfile.mkdtemp(prefix="tidemark-lake-", dir=base))


def _orders_table(spark: SparkSession, sf_dir: str) -> tuple[Table, DataFrame]:
    orders = _read(spark, sf_dir, "orders")
    table = _lake(spark).create("ops", "orders", orders.schema, ["years(o_orderdate)"], ["o_orderkey"])
    table.append(_current(orders))
    return table, orders


@query(_MERGED)
def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, orders = _orders_table(spark, sf_dir)
    table.merge(_updates(orders), _KEY, _VALUES, _AT)
    return table.read()


@query(
    f"""with m as ({_MERGED}), {_CHANGES}, again as (select c.o_orderkey, m.o_orderkey is null as new, u.o_orderdate >= m.o_orderdate and (u.o_custkey is distinct from m.o_custkey or u.o_orderstatus is distinct from m.o_orderstatus
    or u.o_totalprice is distinct from m.o_totalprice or u.o_orderpriority is distinct from m.o_orderpriority) as changed from cls c join upd u using (o_orderkey) left join m using (o_orderkey))
  select (select count(*) from m) as rows, 1 + cast(exists (select * from cls where change <> 'unchanged') as integer) + cast(exists (select * from again where new or changed) as integer) as snapshots,
    cast((select count(*) from again where not new and changed) as integer) as updated, cast((select count(*) from again where new) as integer) as inserted"""
)
def merge_rerun_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merge again commits nothing."""
    table, orders = _orders_table(spark, sf_dir)
    table.merge(_updates(orders), _KEY, _VALUES, _AT)
    again = table.merge(_updates(orders), _KEY, _VALUES, _AT)
    return spark.createDataFrame([(table.read().count(), len(table.load().snapshots), again["updated"], again["inserted"])], "rows long, snapshots int, updated int, inserted int")


@query("select * from orders")
def time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, orders = _orders_table(spark, sf_dir)
    table.append(orders.where("o_orderkey % 3 = 0"))
    first = table.snapshot()["id"]
    table.merge(_updates(orders), _KEY, _VALUES, _AT)
    return table.read(snapshot_id=first)


@query("select * from orders")
def compaction_preserves_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, orders = _orders_table(spark, sf_dir)
    table.append(orders.where("o_orderkey % 3 = 0"))
    compact(table, Options(rewrite_all=True))
    return table.read()


@query("select * from orders where o_orderdate between timestamp '1997-01-01' and timestamp '1997-03-31'")
def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, orders = _orders_table(spark, sf_dir)
    table.append(orders.where("o_orderkey % 3 = 0"))
    return table.read(prune={"o_orderdate": (dt.datetime(1997, 1, 1), dt.datetime(1997, 3, 31))})


@query("select * from events")
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends of all events, with a compaction between, read by the snapshot stream into a table."""
    events = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    lake = _lake(spark)
    table = lake.create("00_bronze", "events", events.schema)
    target = lake.create("01_silver", "events", events.schema)
    spark.dataSource.register(SnapshotSource)

    def run() -> None:
        stream = spark.readStream.format(NAME).option("path", str(table.path)).load()
        stream.writeStream.foreachBatch(lambda df, _: target.append(df)).option("checkpointLocation", str(lake.root / "checkpoint")).trigger(availableNow=True).start().awaitTermination()

    table.append(events.where("event_id % 2 = 0"))
    run()
    table.append(events.where("event_id % 2 <> 0 or event_id is null"))
    compact(table, Options(rewrite_all=True))
    run()
    return target.read().withColumn("ts", F.col("ts").cast("timestamp_ntz"))
