"""Bounded look-ahead scans, lookups, paging and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Look-ahead of schedules and of firings, in seconds; page limits.
SCHEDULE_AHEAD, FIRING_AHEAD, PAGE, MOST_PAGE = 600, 60, 20, 1000


def _plus(now: str, seconds: int) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{now}' + INTERVAL {seconds} SECONDS")


def owned(rows: DataFrame, buckets: DataFrame, broker: int) -> DataFrame:
    """Rows in the buckets of a broker. There are no more than 64 buckets, so that side is broadcast."""
    return rows.join(F.broadcast(buckets.filter(F.col("broker_id") == broker).select("bucket").distinct()), "bucket", "left_semi")


def due_schedules(schedules: DataFrame, now: str, limit: int | None = None, strict: bool = True) -> DataFrame:
    """Enabled schedules due within the look-ahead, by next time and id.

    strict: the original predicate, by which a schedule must have begun a look-ahead ago and end a look-ahead from now;
    else it need only be valid at its next time.
    """
    soon = _plus(now, SCHEDULE_AHEAD)
    valid = (F.col("start_time") <= _plus(now, -SCHEDULE_AHEAD)) & (F.col("end_time") >= soon) if strict else F.col("next_trigger_at").between(F.col("start_time"), F.col("end_time"))
    rows = schedules.filter((F.col("next_trigger_at") <= soon) & valid & F.col("is_enabled") & ~F.col("is_deleted")).orderBy("next_trigger_at", "schedule_id")
    return rows if limit is None else rows.limit(limit)


def due_firings(firings: DataFrame, now: str, after: str | None = None) -> DataFrame:
    """Initial firings due within their look-ahead; `after` leaves out ids up to a cursor."""
    rows = firings.filter((F.col("trigger_at") <= _plus(now, FIRING_AHEAD)) & (F.col("status") == "init") & ~F.col("is_deleted"))
    return rows if after is None else rows.filter(F.col("delay_id") > after)


def expired_firings(firings: DataFrame, end: str) -> DataFrame:
    """Firings to clean, of any state."""
    return firings.filter(F.col("trigger_at") <= _plus(end, 0))


def retained_firings(firings: DataFrame, end: str) -> DataFrame:
    return firings.filter(F.col("trigger_at").isNull() | (F.col("trigger_at") > _plus(end, 0)))


def lookup(rows: DataFrame, **key) -> DataFrame:
    """Rows with these column values, a list meaning any of them; is_deleted rows only if asked for."""
    for name, value in key.items():
        rows = rows.filter(F.col(name).isin(value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return rows.filter(~F.col("is_deleted")) if "is_deleted" in rows.columns and "is_deleted" not in key else rows


def multi_get(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key is among `keys`, by the columns of keys; no hint, as keys may be many."""
    return rows.join(keys.distinct(), keys.columns, "left_semi")


def between(rows: DataFrame, column: str, start: str, end: str) -> DataFrame:
    return rows.filter(F.col(column).between(_plus(start, 0), _plus(end, 0)))


def page(rows: DataFrame, current: int = 1, size: int = PAGE, sort: list[tuple[str, str]] | None = None, key: str = "id") -> DataFrame:
    """A page of rows, by sort columns and directions and then by key descending. Sizes are cut to MOST_PAGE."""
    size = max(1, min(size, MOST_PAGE))
    order = [F.desc(c) if d.lower() == "desc" else F.asc(c) for c, d in sort or []]
    return rows.orderBy(*order, F.desc(key)).offset(size * (max(1, current) - 1)).limit(size)


def page_info(rows: DataFrame, current: int = 1, size: int = PAGE) -> DataFrame:
    """total and has_next of a page."""
    return rows.agg(F.count(F.lit(1)).alias("total")).withColumn("has_next", F.col("total") > current * size)


def name_like(rows: DataFrame, column: str, text: str | None) -> DataFrame:
    """Rows whose column holds the text, in which % and _ stay wildcards; all rows for blank text."""
    return rows if not (text or "").strip() else rows.filter(F.col(column).like(f"%{text}%"))


def top_by(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The row of the largest `order` for each key."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("top")).select(key, "top.*")
