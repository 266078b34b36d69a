"""Daily aggregates, calendar windows and the as-of join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily(df: DataFrame, key: Sequence[str], at: str, measures: dict[str, Column], day: str = "day", count: str = "n", complete_at: int | None = None, complete: str = "is_complete") -> DataFrame:
    """Group by key and UTC day: a count, the measures, and whether the count is the full one."""
    out = df.groupBy(*key, F.to_date(at).alias(day)).agg(F.count(F.lit(1)).cast("int").alias(count), *[c.alias(n) for n, c in measures.items()])
    return out if complete_at is None else out.withColumn(complete, F.col(count) == complete_at)


def rolling_mean(key: Sequence[str], day: str, value: str, days: int = 7) -> Column:
    """Mean over the last ``days`` calendar days, however many rows they have."""
    span = Window.partitionBy(*key).orderBy(F.unix_date(day)).rangeBetween(1 - days, 0)
    return F.avg(value).over(span)


def change_from_yesterday(key: Sequence[str], day: str, value: str) -> Column:
    """Difference to the row before, if that is of the day before; else null."""
    rows = Window.partitionBy(*key).orderBy(F.unix_date(day))
    return F.when(F.date_add(F.lag(day).over(rows), 1) == F.col(day), F.col(value) - F.lag(value).over(rows))


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], left_at: str, right_at: str, values: dict[str, str]) -> DataFrame:
    """Each left row with the newest right row of its key that isn't later; none gives nulls.

    ``values`` maps right columns to their names in the result.  Both sides are put in one
    order and the last right row is carried forward, so a key costs a sort, not a product
    of its rows; among right rows of one time the greatest values win.
    """
    picked = F.struct(F.col(right_at).alias("__at"), *[F.col(c).alias(c) for c in values])
    rows = right.select(*key, F.col(right_at).alias("__t"), F.lit(0).alias("__side"), picked.alias("__v"))
    empty = F.lit(None).cast(rows.schema["__v"].dataType)
    marks = left.select(*key, F.col(left_at).alias("__t"), F.lit(1).alias("__side"), empty.alias("__v"), F.struct(*left.columns).alias("__row"))
    both = rows.where(F.col("__t").isNotNull()).withColumn("__row", F.lit(None).cast(marks.schema["__row"].dataType)).unionByName(marks)
    order = Window.partitionBy(*key).orderBy("__t", "__side", F.col("__v").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("__t").isNotNull() & ~_any_null(key), F.last("__v", ignorenulls=True).over(order))
    found = both.withColumn("__v", known).where("__side = 1")
    return found.select("__row.*", *[F.col(f"__v.{c}").alias(n) for c, n in values.items()])


def _any_null(columns: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def as_of_max_by(left: DataFrame, right: DataFrame, key: Sequence[str], left_at: str, right_at: str, value: str, name: str) -> DataFrame:
    """The same by aggregation: max_by over a join on the key and ``right_at <= left_at``."""
    ids = left.select(*key, left_at).distinct()
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in key], F.col(right_at).alias("__at"), F.col(value).alias("__value"))
    on = F.col("__at") <= F.col(left_at)
    for k in key:
        on = on & (F.col(k) == F.col(f"__r_{k}"))
    found = ids.join(r, on).groupBy(*key, left_at).agg(F.max_by("__value", "__at").alias(name))
    return left.join(found, [*key, left_at], "left")
