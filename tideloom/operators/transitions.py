"""Guarded updates: state changes that apply only from allowed states, alone or folded over an event log."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each event, the states it may leave and the one it leads to.
JOB_EVENTS = {
    "dispatch_success": (("inited",), "dispatched"),
    "start": (("inited", "dispatched"), "running"),
    "run_success": (("running",), "succeed"),
    "run_fail": (("running", "inited"), "failed"),
}
TASK_EVENTS = {
    "dispatch_success": (("inited",), "dispatched"),
    "start": (("dispatched",), "running"),
    "run_success": (("running",), "succeed"),
    "run_fail": (("inited", "running"), "failed"),
}
EXECUTION_EVENTS = {"start": (("inited",), "running"), "run_success": (("running",), "succeed"), "run_fail": (("running",), "failed")}
FIRING_EVENTS = {"start": (("init",), "running"), "run_success": (("running",), "succeed"), "run_fail": (("running",), "failed"), "invalidate": (("init",), "invalid")}


def next_state(status: Column, event: Column, events: Mapping[str, tuple[tuple[str, ...], str]]) -> Column:
    """The state after an event; unchanged where its guard does not hold."""
    new = F.when(F.lit(False), status)
    for name, (allowed, to) in events.items():
        new = new.when((event == name) & status.isin(*allowed), F.lit(to))
    return new.otherwise(status)


def guarded_update(rows: DataFrame, allowed: tuple[str, ...], to: str, where: Column | None = None, **also: Column) -> DataFrame:
    """Rows with the new status and columns where the guard holds, and `applied`."""
    guard = F.coalesce(F.col("status").isin(*allowed) & (F.lit(True) if where is None else where), F.lit(False))
    out = rows.withColumn("applied", guard)
    for name, value in also.items():
        out = out.withColumn(name, F.when(F.col("applied"), value).otherwise(F.col(name)))
    return out.withColumn("status", F.when(F.col("applied"), F.lit(to)).otherwise(F.col("status")))


def mark_liveness(workers: DataFrame, metrics: DataFrame, now: str, timeout_seconds: int = 6) -> DataFrame:
    """Workers (worker_id, status, ...) with `applied`: online if their latest heartbeat is within the timeout before now or
    later, offline if it is older; those without a heartbeat stay as they are."""
    seen = metrics.groupBy("worker_id").agg(F.max("last_heartbeat_at").alias("__seen"))
    alive = F.col("__seen") >= F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {timeout_seconds} SECONDS")
    to = F.when(alive, F.lit("online")).when(~alive, F.lit("offline")).otherwise(F.col("status"))
    changed = workers.join(seen, "worker_id", "left").withColumn("applied", ~F.col("status").eqNullSafe(to)).withColumn("status", to)
    return changed.select(*workers.columns, "applied")


def states_of(events: Mapping, initial: str) -> list[str]:
    """All states that a key can be in."""
    return sorted({initial} | {to for _, to in events.values()})


def _start(status: Column) -> Column:
    return F.struct(status.alias("status"), F.lit(0).cast("bigint").alias("applied"))


def fold_chunks(log: DataFrame, key: str, at: list[str], event: str, events: Mapping, initial: str) -> DataFrame:
    """key, chunk, n events, and for each of states_of where a chunk's events lead from it and how many apply.

    Chunks are partitions of a range by key and time, so a key of many events is in many of them, in order.
    """

    def step(a: Column, e: Column) -> Column:
        new = next_state(a["status"], e["event"], events)
        return F.struct(new.alias("status"), (a["applied"] + F.when(new != a["status"], 1).otherwise(0)).alias("applied"))

    ranged = log.select(key, *at, F.col(event).alias("event")).repartitionByRange(key, *at, "event").withColumn("chunk", F.spark_partition_id())
    ordered = F.array_sort(F.collect_list(F.struct(*at, "event")))
    starts = F.array(*(_start(F.lit(s)) for s in states_of(events, initial)))
    to = F.aggregate(ordered, starts, lambda all_, e: F.transform(all_, lambda a: step(a, e)))
    return ranged.groupBy(key, "chunk").agg(to.alias("to"), F.count(F.lit(1)).alias("n"))


def fold_events(log: DataFrame, key: str, at: list[str], event: str, events: Mapping, initial: str) -> DataFrame:
    """Final status of each key and how many of its events applied: its events in order, each guarded.

    A key's events are a map from the few states to states, with a count: chunks of them are folded to such maps, which
    are then composed, so no task has all events of a key.
    """
    place = F.array(*map(F.lit, states_of(events, initial)))

    def compose(a: Column, c: Column) -> Column:
        to = F.element_at(c["to"], F.array_position(place, a["status"]).cast("int"))
        return F.struct(to["status"].alias("status"), (a["applied"] + to["applied"]).alias("applied"))

    parts = F.array_sort(F.collect_list(F.struct("chunk", "to")))
    chunks = fold_chunks(log, key, at, event, events, initial)
    grouped = chunks.groupBy(key).agg(F.aggregate(parts, _start(F.lit(initial)), compose).alias("s"), F.sum("n").alias("events"))
    return grouped.select(key, F.col("s.status").alias("status"), F.col("s.applied").alias("applied"), "events")


def start_executions(executions: DataFrame, at: Column) -> DataFrame:
    """Executions that may start are running from `at` on (start_at)."""
    allowed, to = EXECUTION_EVENTS["start"]
    return guarded_update(executions, allowed, to, start_at=at)


def finish_executions(executions: DataFrame, success: Column, at: Column) -> DataFrame:
    """Running executions end at `at` (end_at) as succeed or failed; where `success` is null, nothing is reported."""
    allowed, to = EXECUTION_EVENTS["run_success"]
    done = guarded_update(executions, allowed, to, success.isNotNull(), end_at=at)
    return done.withColumn("status", F.when(F.col("applied") & ~success, F.lit(EXECUTION_EVENTS["run_fail"][1])).otherwise(F.col("status")))


def after_failure(jobs: DataFrame, most: Column) -> DataFrame:
    """A failed job is retried, as inited with one more retry, while it may be; else it stays failed. `retried` says which."""
    again = F.coalesce((F.col("status") == "failed") & (F.col("retry_times") < most), F.lit(False))
    out = jobs.withColumn("retried", again)
    out = out.withColumn("retry_times", F.when(F.col("retried"), F.col("retry_times") + 1).otherwise(F.col("retry_times")))
    return out.withColumn("status", F.when(F.col("retried"), F.lit("inited")).otherwise(F.col("status")))


def own_reports(reports: DataFrame, tasks: DataFrame, key: list[str], worker: str) -> DataFrame:
    """Reports of tasks that exist, from the worker that has the task; those of other workers are refused."""
    return reports.join(tasks.select(*key, worker), [*key, worker], "left_semi")


def lease(locks: DataFrame, owner: str, now: str, seconds: int) -> DataFrame:
    """Leases after an attempt to take each: granted when free, expired or already the owner's."""
    at = F.expr(f"TIMESTAMP_NTZ '{now}'")
    free = F.col("owner").isNull() | (F.col("expire_at") < at) | (F.col("owner") == owner)
    out = locks.withColumn("granted", F.coalesce(free, F.lit(True)))
    until = at + F.expr(f"INTERVAL {seconds} SECONDS")
    return out.withColumn("owner", F.when(F.col("granted"), F.lit(owner)).otherwise(F.col("owner"))).withColumn("expire_at", F.when(F.col("granted"), until).otherwise(F.col("expire_at")))


def publish(headers: DataFrame) -> DataFrame:
    """Headers with their draft published and cleared; those without a draft unchanged."""
    has = F.coalesce(F.trim("draft_version") != "", F.lit(False))
    return headers.withColumn("publish_version", F.when(has, F.col("draft_version")).otherwise(F.col("publish_version"))).withColumn("draft_version", F.when(has, F.lit(None)).otherwise(F.col("draft_version")))
