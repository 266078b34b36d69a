import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators.rules import with_reasons
from tidemark.plans.entities import SENSOR_READINGS
from tidemark.sources.config import ConfigError, build_request, parse_config, raw_key, run_date, split_uri
from tidemark.sources.messages import RECORD, latest_per_station, split_messages
from tidemark.streaming.simulator import send, simulate

TEXT = (Path(__file__).parent.parent / "config" / "sources.toml").read_text()


def test_the_committed_configuration_is_valid():
    c = parse_config(TEXT)
    assert [s.bronze_table for s in c.sources] == ["open_meteo_hourly", "wikidata_population"]
    assert c.stream("simulator_readings").max_late_minutes == 90
    with pytest.raises(LookupError, match="open_meteo_hourly, wikidata_population"):
        c.source("nope")


@pytest.mark.parametrize(
    ("old", "new", "said"),
    [
        ("late_rate = 0.1", "late_rate = 1.5", "late_rate must be from 0 to 1"),
        ('kind = "sparql"', 'kind = "ftp"', "kind 'ftp'"),
        ('"cordoba"', '"buenos_aires"', "duplicate station_id buenos_aires"),
        ('"Q44259"', '"44259"', "isn't like Q1234"),
        ("latitude = -54.81", "latitude = -154.81", "latitude must be"),
        ("lag_days = 2", "lag_days = -2", "lag_days must be"),
        ('system = "simulator"', 'System = "simulator"', "system is missing"),
        ("variables = [", "variables = [] #", "needs variables"),
    ],
)
def test_problems_are_named(old, new, said):
    assert old in TEXT
    with pytest.raises(ConfigError, match=said):
        parse_config(TEXT.replace(old, new))


def test_all_problems_come_at_once():
    with pytest.raises(ConfigError) as e:
        parse_config(TEXT.replace("late_rate = 0.1", "late_rate = 2").replace("lag_days = 2", "lag_days = -1"))
    assert "late_rate" in str(e.value) and "lag_days" in str(e.value)


def test_requests_dates_and_keys():
    c = parse_config(TEXT)
    day = dt.date(2026, 1, 5)
    url, headers = build_request(c.sources[0], c.stations[0], day)
    assert "hourly=temperature_2m" in url and headers["User-Agent"].startswith("tidemark")
    assert "start_date=2026-01-05" in url and "timezone=UTC" in url and "temperature_2m%2C" in url
    url, headers = build_request(c.sources[1], c.stations[0], day)
    assert "Q1486" in url and headers["Accept"].startswith("application/sparql")
    assert run_date(c.sources[0], None, dt.date(2026, 1, 10)) == dt.date(2026, 1, 8)
    assert run_date(c.sources[0], "2025-02-03") == dt.date(2025, 2, 3)
    assert raw_key(c.sources[0], c.stations[0], day) == "open_meteo/hourly/date=2026-01-05/buenos_aires.json"


def test_simulated_sensors(spark, tmp_path):
    c = parse_config(TEXT)
    first = dt.datetime(2026, 1, 1, 12, 30, 20, tzinfo=dt.timezone.utc)
    df = simulate(spark, c.stations, c.streams[0], first, 300, seed=3)
    made = df.collect()
    assert sorted(map(str, made)) == sorted(map(str, simulate(spark, c.stations, c.streams[0], first, 300, seed=3).repartition(5).collect()))
    late = [r["sent_at"].replace(tzinfo=None) - dt.datetime.strptime(r["observed_at"], "%Y-%m-%dT%H:%M:%SZ") for r in made if not r["copy"]]
    assert len(late) == 900 == len({r["event_id"] for r in made}) and 40 < sum(r["copy"] for r in made) < 150
    assert all(dt.timedelta(0) <= x <= dt.timedelta(minutes=90) for x in late) and 40 < sum(x > dt.timedelta(0) for x in late) < 200
    checked = with_reasons(SENSOR_READINGS.prepare(df.selectExpr("*", "'m' as _message_id")), SENSOR_READINGS.rules())
    assert checked.where("size(rejection_reasons) > 0").isEmpty()
    send(df, tmp_path / "queue")
    files = list((tmp_path / "queue").glob("*.json"))
    assert sum(len(f.read_text().splitlines()) for f in files) == len(made) and all(len(f.read_text().splitlines()) <= 10 for f in files)
    rows, rejects = split_messages(spark.read.schema(RECORD).json(str(tmp_path / "queue")), "b", F.current_timestamp())
    assert rows.count() == len(made) and rejects.isEmpty()


def test_object_store_uris():
    assert split_uri("s3://bucket/a/b.json") == ("bucket", "a/b.json") and split_uri("s3a://bucket") == ("bucket", "")
    for bad in ("/a/b", "s3:/a", "https://bucket/a", "s3:///a"):
        with pytest.raises(ValueError, match="isn't s3://"):
            split_uri(bad)


def test_entities_are_asked_for_by_their_source_only():
    first, rest = TEXT.split("[[sources]]", 2)[1:][0], TEXT.split("[[streams]]")[1]
    alone = "[[sources]]" + first + "[[streams]]" + rest
    bare = "\n".join(x for x in alone.splitlines() if not x.startswith("entity_id"))
    assert not any(s.entity_id for s in parse_config(bare).stations)
    with pytest.raises(ConfigError, match="entity_id"):
        parse_config("\n".join(x for x in TEXT.splitlines() if not x.startswith("entity_id")))
    with pytest.raises(ConfigError, match="no sources"):
        parse_config("[[streams]]" + rest)


GOOD = {"event_id": "e", "station_id": "a", "observed_at": "2026-01-01T00:00:00Z", "temperature_c": 1.5, "relative_humidity_pct": 70, "precipitation_mm": 0, "wind_speed_kmh": 2.5}


def _records(spark, *bodies):
    rows = [(f"m{k + 1}", b if isinstance(b, str) else json.dumps(b), "1767225600000") for k, b in enumerate(bodies)]
    return spark.createDataFrame(rows, RECORD)


def test_every_record_is_on_one_side(spark):
    without = {k: v for k, v in GOOD.items() if k != "temperature_c"} | {"wind_speed_kmh": None}
    df = _records(spark, GOOD, "not json", [GOOD], GOOD | {"relative_humidity_pct": 70.5}, GOOD | {"relative_humidity_pct": True}, GOOD | {"battery": 1}, without, GOOD | {"relative_humidity_pct": 2**40}, GOOD | {"station_id": 5})
    rows, rejects = split_messages(df, "b", F.current_timestamp())
    assert sorted(r["_message_id"] for r in rows.collect()) == ["m1", "m7"]
    assert rows.columns == [*GOOD, "_message_id", "_sent_at", "_batch_id", "_ingested_at"]
    found = {r["_message_id"]: r["rejection_reasons"] for r in rejects.collect()}
    assert found == {
        "m2": ["not JSON"],
        "m3": ["not a JSON object but array"],
        "m4": ["relative_humidity_pct is not int"],
        "m5": ["relative_humidity_pct is not int"],
        "m6": ["unknown field battery"],
        "m8": ["relative_humidity_pct is not int"],
        "m9": ["station_id is not string"],
    }
    assert rows.where("_message_id = 'm7'").first()["temperature_c"] is None
    assert rows.select(F.date_format("_sent_at", "yyyy-MM-dd")).first()[0] == "2026-01-01"


def test_latest_per_station(spark):
    at = lambda t, **more: GOOD | {"observed_at": t} | more
    df = _records(spark, at("2026-01-01T14:07:00Z", temperature_c=18.5), at("2026-01-01T12:40:00Z"), at("2026-01-01T14:06:00+00:00", station_id="u"), at("yesterday", station_id="c"), at("2026-01-01T14:07:00", station_id="c"), at("2026-01-01T14:07:00Z", station_id=None))
    rows, _ = split_messages(df, "b", F.current_timestamp())
    found = {r["station_id"]: r for r in latest_per_station(rows).collect()}
    assert sorted(found) == ["a", "u"]
    assert found["a"]["temperature_c"] == 18.5 and found["u"]["observed_at"] == "2026-01-01T14:06:00Z"
