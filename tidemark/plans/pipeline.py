"""Pipelines: a source from ingest to silver, the gold build, and backfills."""

from __future__ import annotations

import datetime as dt
import fcntl
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from pathlib import Path
from typing import Any, TypeVar

from ..sources.config import Config, run_date
from ..sources.raw import Fetch, http_fetch, ingest
from ..store.lake import CommitConflict, Lake
from .entities import ENTITIES
from .jobs import build_gold, clean, load_raw

# Schedules (cron, UTC), limits of a backfill, length of a run id.
SCHEDULES = {"weather": "0 6 * * *", "population": "0 7 1 * *", "sensors": "5 * * * *", "maintenance": "0 8 * * 0", "simulator": "* * * * *"}
BACKFILL_DAYS = 31
BACKFILL_AT_ONCE = 2
RUN_ID_LENGTH = 80
TRANSIENT = (ConnectionError, TimeoutError, CommitConflict)

T = TypeVar("T")


def retry(work: Callable[[], T], attempts: int = 3, wait: float = 5.0, factor: float = 2.0, transient: tuple[type[BaseException], ...] = TRANSIENT, sleep: Callable[[float], None] = time.sleep) -> T:
    """Runs ``work`` again after transient errors only; others are raised at once."""
    for k in range(attempts):
        try:
            return work()
        except transient:
            if k == attempts - 1:
                raise
            sleep(wait * factor**k)
    raise AssertionError


class Busy(RuntimeError):
    """Another run holds the lock."""


@contextmanager
def single_writer(path: str | Path) -> Iterator[None]:
    """One run at a time beside a checkpoint or table; the lock goes with the process."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise Busy(f"{path} is held by another run") from None
        yield


def run_gold(lake: Lake, triggered_by: str = "manual", attempts: int = 5, wait: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> dict[str, Any]:
    """Builds the gold table, one run at a time."""

    def work() -> dict[str, Any]:
        with single_writer(lake.root / ".locks" / "gold"):
            return build_gold(lake)

    return retry(work, attempts, wait, transient=(Busy,), sleep=sleep) | {"triggered_by": triggered_by}


def run_source(
    lake: Lake,
    config: Config,
    name: str,
    landing: str | Path,
    date: dt.date | str | None = None,
    batch_id: str | None = None,
    fetch: Fetch = http_fetch,
    then_gold: bool = True,
    alert: Callable[[str], None] = lambda m: None,
    sleep: Callable[[float], None] = time.sleep,
) -> dict[str, Any]:
    """Ingest, load, clean; the gold build follows every success that isn't part of a backfill."""
    source = config.source(name)
    day = run_date(source, date)
    batch = batch_id or f"{name}-{day.isoformat()}-{int(time.time() * 1000)}"
    try:
        keys = retry(lambda: ingest(config, source, day, landing, fetch), sleep=sleep)
        loaded = load_raw(lake, source, day, batch, landing)
        entity = ENTITIES[source.silver_job.removeprefix("clean_")]
        cleaned = retry(lambda: clean(lake, entity, source.bronze_table, batch), sleep=sleep)
    except Exception as e:
        alert(f"{name} for {day} failed: {e}")
        raise
    report = {"source": name, "date": day.isoformat(), "batch_id": batch, "keys": keys, "loaded": loaded, "cleaned": cleaned}
    if then_gold and not batch.startswith("backfill-"):
        report["gold"] = run_gold(lake, triggered_by=batch, sleep=sleep)
    return report


class BackfillFailed(RuntimeError):
    """Some dates failed; the others, and the gold table, are done."""


def backfill(lake: Lake, config: Config, name: str, landing: str | Path, first: dt.date, last: dt.date, run: str, fetch: Fetch = http_fetch, alert: Callable[[str], None] = lambda m: None, sleep: Callable[[float], None] = time.sleep) -> dict[str, Any]:
    """Runs a source for each date, two at a time, and the gold build once at the end."""
    days = (last - first).days + 1
    if not 1 <= days <= BACKFILL_DAYS:
        raise ValueError(f"a backfill has 1 to {BACKFILL_DAYS} days, not {days}")
    dates = [first + dt.timedelta(days=k) for k in range(days)]

    def one(day: dt.date) -> tuple[dt.date, Any]:
        try:
            return day, run_source(lake, config, name, landing, day, f"backfill-{day.isoformat()}-{run}"[:RUN_ID_LENGTH], fetch, False, alert, sleep)
        except Exception as e:  # noqa: BLE001  collected and raised below
            return day, e

    with ThreadPoolExecutor(BACKFILL_AT_ONCE) as pool:
        done = dict(pool.map(one, dates))
    failed = {d: e for d, e in done.items() if isinstance(e, Exception)}
    report: dict[str, Any] = {"runs": {d.isoformat(): r for d, r in done.items() if d not in failed}}
    if report["runs"]:
        report["gold"] = run_gold(lake, triggered_by=f"backfill {run}", sleep=sleep)
    if failed:
        raise BackfillFailed("; ".join(f"{d}: {e}" for d, e in sorted(failed.items())))
    return report
