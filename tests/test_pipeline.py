import datetime as dt
import json
import random
from pathlib import Path

import pytest

from tidemark.plans import governance, jobs, pipeline
from tidemark.plans.entities import SENSOR_READINGS
from tidemark.sources.config import parse_config
from tidemark.store.lake import Lake
from tidemark.store.maintenance import Options
from tidemark.streaming.cleaner import clean_stream, watermark_of
from tidemark.streaming.consumer import run_consumer
from tidemark.streaming.simulator import send, simulate

ROOT = Path(__file__).parent.parent
CONFIG = parse_config((ROOT / "config" / "sources.toml").read_text())
DAY = dt.date(2026, 1, 5)


def no_wait(_):
    pass


@pytest.fixture
def lake(spark, tmp_path):
    found = Lake(spark, tmp_path / "lake")
    assert len(jobs.apply_ddl(found, ROOT / "migrations")["applied"]) == 14
    return found


def fetch(url, headers, warm=10.0, fail=()):
    """A recorded answer for either kind of source."""
    if "sparql" in url:
        term = lambda v: {"type": "literal", "value": v}
        rows = [{"population": term("1000"), "point_in_time": term("2020-01-01T00:00:00Z"), "rank": term("http://x#PreferredRank")}, {"population": term("-5"), "point_in_time": term("2021-01-01T00:00:00Z"), "rank": term("http://x#NormalRank")}]
        return json.dumps({"head": {"vars": ["population"]}, "results": {"bindings": rows}}).encode()
    day = url.split("start_date=")[1][:10]
    if day in fail:
        raise ValueError("no such day")
    hours = [f"{day}T{h:02d}:00" for h in range(24)]
    lists = {"time": hours, "temperature_2m": [warm + h for h in range(24)], "relative_humidity_2m": [50] * 24, "precipitation": [0.5] * 24, "wind_speed_10m": [3.0] * 24}
    units = {"time": "iso8601", "temperature_2m": "°C", "relative_humidity_2m": "%", "precipitation": "mm", "wind_speed_10m": "km/h"}
    return json.dumps({"latitude": 1.0, "longitude": 1.0, "utc_offset_seconds": 0, "timezone": "UTC", "hourly_units": units, "hourly": lists}).encode()


def test_sources_to_gold(lake, tmp_path):
    run = lambda name, batch, f=fetch: pipeline.run_source(lake, CONFIG, name, tmp_path / "raw", DAY, batch, f, name == "open_meteo_hourly", sleep=no_wait)
    found = run("wikidata_population", "p1")["cleaned"]
    assert (found["input"], found["rejected"], found["new"]) == (6, 3, 3)
    first = run("open_meteo_hourly", "w1")
    assert (first["cleaned"]["new"], first["gold"]["rows"], first["gold"]["published"]) == (72, 3, True)
    again = run("open_meteo_hourly", "w2")
    assert (again["cleaned"]["unchanged"], again["cleaned"]["snapshot_id"], again["gold"]["published"]) == (72, None, False)
    warmer = run("open_meteo_hourly", "w3", lambda u, h: fetch(u, h, 11.0))
    assert (warmer["cleaned"]["changed"], warmer["gold"]["published"]) == (72, True)
    rerun = jobs.clean(lake, pipeline.ENTITIES["populations"], "wikidata_population", "p1")
    assert rerun["unchanged"] == 3 and rerun["quarantine_snapshot_id"] is None
    with pytest.raises(jobs.EmptyBatch):
        jobs.clean(lake, pipeline.ENTITIES["readings"], "open_meteo_hourly", "none")
    seen = governance.view(lake, governance.ANALYSTS)
    assert "population" not in seen.columns and seen.count() == 2
    assert governance.may_describe(lake.table("02_gold", "agg_readings_daily")) and not governance.may_describe(lake.table("01_silver", "readings"))


def test_backfill_and_alerts(lake, tmp_path):
    pipeline.run_source(lake, CONFIG, "wikidata_population", tmp_path / "raw", DAY, "p1", fetch, False, sleep=no_wait)
    said = []
    bad = (DAY + dt.timedelta(days=1)).isoformat()
    with pytest.raises(pipeline.BackfillFailed, match=bad):
        pipeline.backfill(lake, CONFIG, "open_meteo_hourly", tmp_path / "raw", DAY, DAY + dt.timedelta(days=2), "r1", lambda u, h: fetch(u, h, fail={bad}), said.append, no_wait)
    assert len(said) == 1 and bad in said[0]
    assert lake.table("02_gold", "agg_readings_daily").read().count() == 6
    with pytest.raises(ValueError, match="1 to 31"):
        pipeline.backfill(lake, CONFIG, "open_meteo_hourly", tmp_path, DAY, DAY + dt.timedelta(days=31), "r2")


def test_retry_and_lock(tmp_path):
    calls = []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "done"

    waits = []
    assert pipeline.retry(work, sleep=waits.append) == "done" and waits == [5.0, 10.0]
    with pytest.raises(ValueError):
        pipeline.retry(lambda: int("x"), sleep=waits.append)
    with pipeline.single_writer(tmp_path / "lock"):
        with pytest.raises(pipeline.Busy):
            with pipeline.single_writer(tmp_path / "lock"):
                pass


def test_stream_from_queue_to_silver(lake, spark, tmp_path):
    now = dt.datetime(2026, 1, 1, 12, 0, tzinfo=dt.timezone.utc)
    queue, marks = tmp_path / "queue", lake.table("ops", "watermarks")
    source = lake.table("00_bronze", "simulator_readings")

    def minutes(first, count):
        made = simulate(spark, CONFIG.stations, CONFIG.streams[0], now + dt.timedelta(minutes=first), count, seed=5)
        send(made, queue)
        return {r["event_id"]: (r["station_id"], r["observed_at"]) for r in made.collect()}

    keys = minutes(0, 4)
    (queue / "bad.json").write_text('{"messageId": "bad", "body": "not json", "SentTimestamp": "1767268800000"}\n')
    consume = lambda: run_consumer(lake, queue, tmp_path / "cp-queue", tmp_path / "dead", latest=("ops", "latest_readings"))
    reports = consume()
    assert not any(r["failed"] for r in reports) and sum(r["latest"]["updated"] for r in reports) >= 3
    assert lake.table("00_bronze", "simulator_readings_quarantine").read().count() == 1
    clean = lambda: clean_stream(lake, tmp_path / "cp-clean", marks)
    first = clean()
    silver = lake.table("01_silver", SENSOR_READINGS.name)
    assert silver.read().count() == len(set(keys.values())) and first["watermark_moved"]
    keys |= minutes(4, 3)
    consume()
    jobs.maintain_tables(lake, Options(expire_days=0, retain_last=1), ["00_bronze"], ["simulator_readings"], current=dt.datetime.now(dt.timezone.utc) + dt.timedelta(days=1))
    second = clean()
    assert silver.read().count() == len(set(keys.values())) and second["snapshot_id"] > first["snapshot_id"]
    assert watermark_of(marks, source) is not None
    assert clean()["snapshot_id"] == second["snapshot_id"]
    newest = {r["station_id"]: r["observed_at"] for r in lake.table("ops", "latest_readings").read().collect()}
    assert newest == {s: max(t for x, t in keys.values() if x == s) for s in newest}


def test_messages_come_again_and_then_go_to_the_dead_letters(lake, spark, tmp_path, monkeypatch):
    queue = tmp_path / "queue"
    queue.mkdir()
    for k in range(12):
        (queue / f"{k}.json").write_text(json.dumps({"messageId": f"m{k}", "body": "not json" if k % 2 else "{}", "SentTimestamp": "0"}) + "\n")
    lake.table("00_bronze", "simulator_readings_quarantine").drop()
    run = lambda: run_consumer(lake, queue, tmp_path / "cp", tmp_path / "dead", files_at_once=5)
    tries = [run(), run(), run(), run()]
    assert [len(r) for r in tries] == [3, 2, 2, 0] or [sum(x.get("dead", 0) for x in r) for r in tries] == [0, 0, 6, 0]
    assert lake.table("00_bronze", "simulator_readings").read().count() == 6
    dead = spark.read.json(str(tmp_path / "dead")).collect()
    assert {r["messageId"] for r in dead} == {f"m{k}" for k in range(1, 12, 2)} and {r["tries"] for r in dead} == {3}
