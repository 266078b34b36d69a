"""Row and column policies, and a limit on what a query may scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


class ScanLimitError(RuntimeError):
    """The files behind a query are larger than the limit."""


def secure_view(df: DataFrame, rows: str | None = None, exclude: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Only the rows under ``rows``, and no sign of the excluded columns; optionally as a view.

    The filter may use excluded columns, as it is applied first.
    """
    unknown = set(exclude) - set(df.columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    out = (df if rows is None else df.where(rows)).select(*[c for c in df.columns if c not in exclude])
    if name:
        out.createOrReplaceTempView(name)
    return out


def require_scan_within(sizes: Sequence[int], limit: int = 1 << 30) -> int:
    """Sum of the file sizes that a scan would read; raises above the limit."""
    total = sum(sizes)
    if total > limit:
        raise ScanLimitError(f"{total} bytes to scan, the limit is {limit}")
    return total
