"""Scalar functions of the scheduler as column expressions: hashes, ids, JSON, time, addresses, enums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States of jobs, tasks, executions and firings, and which of them are final.
JOB_STATES = ("inited", "dispatched", "running", "succeed", "failed", "restarted", "cancelled", "terminated", "paused")
EXECUTION_STATES = ("inited", "running", "succeed", "failed", "killing", "cancelled", "paused")
JOB_FINISHED = ("succeed", "failed", "cancelled", "terminated")
EXECUTION_FINISHED = ("failed", "succeed", "cancelled")
#: Number of buckets, and the two time formats that are read.
BUCKETS = 64
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss")


def java_hash(text: Column) -> Column:
    """The 32-bit string hash s[0]*31^(n-1) + ... as a signed long; null for null. For characters of the basic plane."""
    h = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda a, c: (a * 31 + F.ascii(c)).bitwiseAND(0xFFFFFFFF))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h)


def bucket_of(id: Column, buckets: int = BUCKETS) -> Column:
    """Bucket 1 to `buckets` of an id."""
    return (F.abs(java_hash(id)) % buckets + 1).cast("int")


def non_blank(text: Column) -> Column:
    """The text, null when blank."""
    return F.when(F.trim(text) != "", text)


def short_uuid() -> Column:
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8)


def fingerprint(*columns: Column) -> Column:
    """MD5 of the columns as JSON, fields in the order given, nulls left out."""
    return F.md5(F.to_json(F.struct(*columns)))


def delay_id(schedule_id: Column, trigger_at: Column) -> Column:
    return F.concat_ws("_", schedule_id.cast("string"), F.date_format(trigger_at, TIME_FORMATS[0]))


def to_json(value: Column, default: str = "") -> Column:
    """JSON of a struct without its null fields; `default` for null."""
    return F.coalesce(F.to_json(value, {"timestampNTZFormat": TIME_FORMATS[0]}), F.lit(default))


def from_json(text: Column, schema: str, strict: bool = False) -> Column:
    """Struct from JSON; blank is null, unknown fields are dropped. strict: malformed text fails the query."""
    return F.from_json(non_blank(text), schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"})


def json_type(text: Column) -> Column:
    """The type tag of polymorphic JSON: its last part if it is a full class name."""
    return F.element_at(F.split(F.get_json_object(text, "$.type"), r"\."), -1)


def parse_time(text: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS)).cast("timestamp_ntz")


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")


def begin_of_day(ts: Column) -> Column:
    return F.date_trunc("day", ts).cast("timestamp_ntz")


def end_of_day(ts: Column) -> Column:
    """The last millisecond of the day."""
    return begin_of_day(ts) + F.expr("INTERVAL '23:59:59.999' HOUR TO SECOND")


def later_of(a: Column, b: Column) -> Column:
    """The later time; the other one if one is null."""
    return F.greatest(a, b)


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def ms_until(at: Column, now: Column) -> Column:
    """Milliseconds until a time, 0 if it is past, null for null."""
    return F.when(at.isNotNull(), F.greatest(F.lit(0).cast("bigint"), epoch_ms(at) - epoch_ms(now)))


def enum_of(text: Column, values: tuple[str, ...]) -> Column:
    return F.when(text.isin(*values), text).otherwise(F.lit("unknown"))


def is_finished(status: Column, finished: tuple[str, ...] = JOB_FINISHED) -> Column:
    return F.coalesce(status.isin(*finished), F.lit(False))


def retry_allowed(retried: Column, most: Column) -> Column:
    return retried < most


def address(url: Column) -> Column:
    """protocol, host and port of protocol://host:port; null when malformed."""
    pattern = r"^([a-z][a-z0-9+.-]*)://([^/:?#\s]+):(\d{1,5})$"
    parts = [F.regexp_extract(url, pattern, i) for i in (1, 2, 3)]
    return F.when(url.rlike(pattern), F.struct(parts[0].alias("protocol"), parts[1].alias("host"), parts[2].cast("int").alias("port")))


def first_error(*checks: tuple[Column, str]) -> Column:
    """The code of the first check that holds, null when none does."""
    return reduce(lambda tail, c: F.when(c[0], F.lit(c[1])).otherwise(tail), reversed(checks), F.lit(None).cast("string"))
