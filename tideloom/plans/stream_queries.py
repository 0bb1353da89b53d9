"""Queries that drain a stream over the events and read its sink."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import functions as F

from ..streaming import liveness as N
from .join_queries import FOLD
from .registry import query


def sink(t) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, else (one machine) a temporary one."""
    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", t.spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/tideloom/stream-{uuid.uuid4().hex[:12]}" if base else "file://" + tempfile.mkdtemp(prefix="stream-")


def _events(t):
    return N.read_stream(t.spark, t.folder, "events.parquet", t("events"))


def _beats(t):
    return _events(t).select(F.col("user_id").alias("node_id"), F.col("ts").alias("at"))


@query("SELECT user_id AS node_id, time_bucket(INTERVAL 10 SECOND, ts) AS start, count(*) AS beats FROM events GROUP BY 1, 2")
def stream_online_windows(t):
    return N.drain(N.online_windows(_beats(t), late="60 days"), sink(t), "update", ["node_id", "start"])


@query("SELECT user_id AS server_id, b - INTERVAL 5 MINUTE * o AS start, count(*) AS accesses FROM (SELECT user_id, time_bucket(INTERVAL 5 MINUTE, ts) AS b, unnest([0, 1]) AS o FROM events) x GROUP BY 1, 2")
def stream_access_windows(t):
    log = _events(t).select(F.col("user_id").alias("server_id"), F.col("ts").alias("dispatch_at"))
    return N.drain(N.access_windows(log, retention="60 days"), sink(t), "update", ["server_id", "start"])


@query(f"SELECT user_id AS node_id, max(ts) AS last_at, count(*) AS beats FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 SECOND")
def stream_offline_nodes(t):
    return N.offline(N.drain(N.last_seen(_beats(t)), sink(t), "update", ["node_id"]), "2024-01-30 12:00:00")


@query("""SELECT user_id AS node_id, min(ts) AS online_at, max(ts) AS last_at, max(ts) + INTERVAL 3600 SECOND AS offline_at, count(*) AS beats FROM (
    SELECT user_id, ts, sum(CASE WHEN ts <= before + INTERVAL 3600 SECOND THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS spell FROM (
        SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE ts IS NOT NULL) x) y
    GROUP BY user_id, spell HAVING max(ts) + INTERVAL 3600 SECOND <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 3600 SECOND FROM events)""")
def stream_online_spells(t):
    return N.drain(N.online_spells(_beats(t), 3600), sink(t))


@query("SELECT user_id, event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1, 2")
def stream_first_reports(t):
    got = N.drain(N.first_reports(_events(t).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "60 days"), sink(t))
    return got.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT job_id, split_part(s, ':', 1) AS status, CAST(split_part(s, ':', 2) AS BIGINT) AS applied FROM (SELECT job_id, {FOLD} AS s FROM {{job_event}} GROUP BY job_id) x")
def stream_report_states(t):
    names = F.element_at(F.array(*(F.lit(x) for x in ("dispatch_success", "start", "run_success", "run_fail", "report"))), (F.col("event_id") % 5 + 1).cast("int"))
    log = _events(t).select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), "event_id", names.alias("event"))
    return N.drain(N.report_states(log), sink(t), "update", ["job_id"])


