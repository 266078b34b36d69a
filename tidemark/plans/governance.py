"""Who may see what: layer tags, row and column policies by role, the scan limit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.secure import require_scan_within, secure_view
from ..store.lake import Lake, Table


@dataclass(frozen=True)
class Policy:
    """A role's view of a table."""

    table: str
    rows: str | None = None
    exclude: tuple[str, ...] = ()


# The analysts' view of the daily table and the scan limit of a query.
ANALYSTS = Policy("02_gold.agg_readings_daily", "station_id in ('buenos_aires', 'cordoba')", ("population",))
SCAN_LIMIT = 1 << 30


def may_describe(table: Table, layers: Sequence[str] = ("gold",)) -> bool:
    """Grants by tag: the table property ``layer``."""
    return table.properties().get("layer") in layers


def granted(lake: Lake, tags: dict[str, Sequence[str]]) -> list[str]:
    """Tables that a role may use: those whose properties have one of the values of every tag granted."""
    out = []
    for db in lake.databases():
        for name in lake.tables(db):
            properties = lake.table(db, name).properties()
            if tags and all(properties.get(tag) in values for tag, values in tags.items()):
                out.append(f"{db}.{name}")
    return out


def view(lake: Lake, policy: Policy, name: str | None = None, scan_limit: int = SCAN_LIMIT) -> DataFrame:
    db, _, table = policy.table.partition(".")
    found = lake.table(db, table)
    require_scan_within([f["bytes"] for f in found.plan_files()], scan_limit)
    return secure_view(found.read(), policy.rows, policy.exclude, name)
