import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar, checks, daily_weather

SCHEMA = "station_id string, observed_at timestamp, temperature_c double, relative_humidity_pct int, precipitation_mm double, wind_speed_kmh double"


def hours(spark, *rows):
    return spark.createDataFrame([("a", dt.datetime(2026, 1, d, h), t, 50, 0.5, 3.0) for d, h, t in rows], SCHEMA)


def populations(spark, *rows):
    return spark.createDataFrame([("a", dt.date(y, 1, 1), n) for y, n in rows], "station_id string, reference_date date, population bigint")


def test_a_day_is_summed(spark):
    r = daily_weather.daily_weather(hours(spark, (1, 0, 0.0), (1, 1, 2.0), (1, 2, 4.0))).first()
    assert (r["hours_observed"], r["is_complete_day"], r["temperature_min_c"], r["temperature_avg_c"], r["temperature_max_c"], r["precipitation_total_mm"]) == (3, False, 0.0, 2.0, 4.0, 1.5)


def test_windows_are_calendar_days(spark):
    df = daily_weather.with_trends(daily_weather.daily_weather(hours(spark, (20, 0, 10.0), (21, 0, 12.0), (23, 0, 20.0))))
    out = [(r["temperature_change_c"], r["temperature_avg_7d_c"]) for r in df.orderBy("reading_date").collect()]
    assert out == [(None, 10.0), (2.0, 11.0), (None, 14.0)]


@pytest.mark.parametrize("how", ["carry", "max_by"])
def test_as_of_takes_the_newest_that_is_not_later(spark, how):
    days = spark.createDataFrame([("a", dt.date(y, 6, 1)) for y in (2005, 2015, 2026)] + [("b", dt.date(2026, 1, 1)), (None, dt.date(2026, 1, 1))], "station_id string, day date")
    known = populations(spark, (2010, 7), (2022, 9))
    if how == "carry":
        out = calendar.as_of(days, known, ["station_id"], "day", "reference_date", {"population": "population"})
    else:
        out = calendar.as_of_max_by(days, known, ["station_id"], "day", "reference_date", "population", "population")
    assert [r["population"] for r in out.where("station_id = 'a'").orderBy("day").collect()] == [None, 7, 9]
    assert out.count() == 5 and out.where("station_id is null or station_id = 'b'").select("population").distinct().collect()[0][0] is None


def _gold(spark):
    silver = hours(spark, (1, 0, 1.0), (2, 0, 2.0))
    return daily_weather.build(silver, populations(spark, (2020, 5))), silver


def _failed(gold, silver):
    return [c.name for c in checks.daily_weather_checks(gold, silver, daily_weather.REQUIRED) if not c.passed]


def test_checks(spark):
    gold, silver = _gold(spark)
    assert gold.columns == list(daily_weather.COLUMNS)
    assert _failed(gold, silver) == []
    assert _failed(gold.where("reading_date > '2026-01-01'"), silver) == ["hours_reconcile", "precipitation_reconciles"]
    assert _failed(gold.unionAll(gold), silver) == ["unique_key", "hours_reconcile", "precipitation_reconciles"]
    assert _failed(gold.where("false"), silver) == ["not_empty", "hours_reconcile", "precipitation_reconciles"]
    broken = gold.withColumns({"hours_observed": F.lit(25), "temperature_min_c": F.lit(99.0), "population": F.lit(None).cast("bigint")})
    assert _failed(broken, silver) == ["hours_in_range", "temperature_order", "population_found", "hours_reconcile"]
    with pytest.raises(checks.DataQualityError, match="not_empty.*hours_reconcile"):
        checks.require_passed(checks.daily_weather_checks(gold.where("false"), silver, daily_weather.REQUIRED))
