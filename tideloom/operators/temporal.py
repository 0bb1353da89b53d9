"""When schedules fire next, and which firings they expand to."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cron import next_after
from ..functions.scalar import delay_id, plus_seconds


def _first(now: Column) -> Column:
    return F.greatest(plus_seconds(F.col("start_time"), F.col("schedule_delay")), now)


def next_fixed_rate(now: Column) -> Column:
    """An interval after the last trigger, at first start and delay; never before now. Without an interval now."""
    on = F.greatest(plus_seconds(F.col("last_trigger_at"), F.col("schedule_interval")), now)
    return F.when(F.col("schedule_interval").isNull(), now).when(F.col("last_trigger_at").isNull(), _first(now)).otherwise(on)


def next_fixed_delay(now: Column) -> Column:
    """An interval after the last feedback; null while a triggered run has not reported; at first like fixed rate."""
    on = F.greatest(plus_seconds(F.col("last_feedback_at"), F.col("schedule_interval")), now)
    return (
        F.when(F.col("schedule_interval").isNull(), now).when(F.col("last_feedback_at").isNotNull(), on)
        .when(F.col("last_trigger_at").isNotNull(), F.lit(None)).otherwise(_first(now))
    )


def _cron_rows(dialect: str):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            times = [next_after(x, dialect, None if pd.isna(at) else at.to_pydatetime()) for x, at in zip(b["schedule_cron"], b["after"])]
            yield pd.DataFrame({"schedule_id": b["schedule_id"], "next_at": pd.Series(times, dtype="datetime64[us]")})

    return rows


def next_cron(schedules: DataFrame, now: str, dialect: str = "QUARTZ") -> DataFrame:
    """schedule_id and next_at: strictly after the last trigger, else after now; null for a bad expression.

    No built-in function knows calendars of fields, so expressions are matched in Arrow batches.
    """
    after = F.coalesce("last_trigger_at", F.expr(f"TIMESTAMP_NTZ '{now}'")).alias("after")
    return schedules.select("schedule_id", "schedule_cron", after).mapInPandas(_cron_rows(dialect), "schedule_id long, next_at timestamp_ntz")


def next_trigger(schedules: DataFrame, now: str, dialect: str = "QUARTZ") -> DataFrame:
    """schedule_id, schedule_type and next_at by type; null for a type that never fires. Only cron rows leave the engine.

    An unknown or null type has no calculator: it is null here and an error in config_errors.
    """
    at = F.expr(f"TIMESTAMP_NTZ '{now}'")
    plain = schedules.filter("schedule_type IS NULL OR schedule_type <> 'cron'")
    simple = plain.select("schedule_id", "schedule_type", F.when(F.col("schedule_type") == "fixed_rate", next_fixed_rate(at)).when(F.col("schedule_type") == "fixed_delay", next_fixed_delay(at)).alias("next_at"))
    cron = next_cron(schedules.filter("schedule_type = 'cron'"), now, dialect).select("schedule_id", F.lit("cron").alias("schedule_type"), "next_at")
    return simple.unionByName(cron)


def expand_fixed_rate(schedules: DataFrame, now: str, ahead_seconds: int = 600) -> DataFrame:
    """All firings of fixed-rate schedules from their next one to the look-ahead or their end; one generator, no loop."""
    at = F.expr(f"TIMESTAMP_NTZ '{now}'")
    first, last = next_fixed_rate(at), F.least(F.col("end_time"), at + F.expr(f"INTERVAL {ahead_seconds} SECONDS"))
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("schedule_interval").cast("decimal(18,6)"))
    rows = schedules.filter("schedule_type = 'fixed_rate' AND schedule_interval > 0").withColumn("first", first).withColumn("last", last).filter("first <= last")
    return rows.select("schedule_id", F.explode(F.sequence("first", "last", step)).alias("trigger_at"))


def catch_up(schedules: DataFrame, now: str, dialect: str = "QUARTZ") -> DataFrame:
    """schedule_id, schedule_type and next_at: the planned next trigger, recomputed by type when it is past.

    Missed ones collapse: the recomputation takes the last trigger for the last feedback, too.
    """
    at = F.expr(f"TIMESTAMP_NTZ '{now}'")
    planned = F.col("next_trigger_at") >= at
    again = next_trigger(schedules.filter(~F.coalesce(planned, F.lit(False))).withColumn("last_feedback_at", F.col("last_trigger_at")), now, dialect)
    return schedules.filter(planned).select("schedule_id", "schedule_type", F.col("next_trigger_at").alias("next_at")).unionByName(again)


def _cron_firings(dialect: str):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            firings, nexts = [], []
            for cron, at, lo, hi in zip(b["schedule_cron"], b["next_at"], b["lo"], b["hi"]):
                own, at = [], None if pd.isna(at) else at.to_pydatetime()
                while at is not None and lo <= at <= hi:
                    own.append(at)
                    at = next_after(cron, dialect, at)
                firings.append(own)
                nexts.append(at)
            yield pd.DataFrame({"schedule_id": b["schedule_id"], "firings": firings, "next": pd.Series(nexts, dtype="datetime64[us]")})

    return rows


def plan_firings(schedules: DataFrame, now: str, ahead_seconds: int = 600, dialect: str = "QUARTZ") -> DataFrame:
    """schedule_id, firings, last_trigger_at and next_trigger_at of each enabled schedule after it was triggered at `now`.

    Firings lie within the schedule's validity and the look-ahead, which bounds their number: all of a fixed rate or cron,
    one of a fixed delay, whose next one waits for its feedback and is null. Without a firing last is kept and next is what
    catch_up gives. Only cron rows leave the engine.
    """
    at = F.expr(f"TIMESTAMP_NTZ '{now}'")
    own = schedules.filter("is_enabled").join(catch_up(schedules.filter("is_enabled"), now, dialect).select("schedule_id", "next_at"), "schedule_id")
    own = own.withColumn("lo", F.greatest(at, F.col("start_time"))).withColumn("hi", F.least(F.col("end_time"), at + F.expr(f"INTERVAL {ahead_seconds} SECONDS")))
    due, none = F.coalesce(F.col("next_at").between(F.col("lo"), F.col("hi")), F.lit(False)), F.array().cast("array<timestamp_ntz>")
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("schedule_interval").cast("decimal(18,6)"))
    rate = F.when(due, F.when(F.col("schedule_interval") > 0, F.sequence("next_at", "hi", step)).otherwise(F.array("next_at"))).otherwise(none)
    one = F.when(due, F.array("next_at")).otherwise(none)
    fixed = own.filter("schedule_type <> 'cron'").withColumn("firings", F.when(F.col("schedule_type") == "fixed_rate", rate).otherwise(one))
    after = F.when(F.size("firings") == 0, F.col("next_at")).when(F.col("schedule_type") == "fixed_rate", plus_seconds(F.element_at("firings", -1), F.col("schedule_interval")))
    columns = ["schedule_id", "firings", F.coalesce(F.try_element_at("firings", F.lit(-1)), "last_trigger_at").alias("last_trigger_at"), "next_trigger_at"]
    fixed = fixed.withColumn("next_trigger_at", after).select(*columns)
    cron = own.filter("schedule_type = 'cron'")
    found = cron.select("schedule_id", "schedule_cron", "next_at", "lo", "hi").mapInPandas(_cron_firings(dialect), "schedule_id long, firings array<timestamp_ntz>, next timestamp_ntz")
    cron = cron.join(found, "schedule_id").withColumn("next_trigger_at", F.col("next")).select(*columns)
    return fixed.unionByName(cron)


def firings_of(planned: DataFrame) -> DataFrame:
    """A row for each planned firing: delay_id, schedule_id, trigger_at, status init."""
    rows = planned.select("schedule_id", F.explode("firings").alias("trigger_at"))
    return rows.select(delay_id(F.col("schedule_id"), F.col("trigger_at")).alias("delay_id"), "schedule_id", "trigger_at", F.lit("init").alias("status"))


def carried(schedules: DataFrame, planned: DataFrame) -> DataFrame:
    """`schedules` with the last and next trigger that planning left; others unchanged."""
    new = planned.select("schedule_id", F.col("last_trigger_at").alias("__last"), F.col("next_trigger_at").alias("__next"), F.lit(True).alias("__planned"))
    rows = schedules.join(new, "schedule_id", "left")
    for name, value in (("last_trigger_at", "__last"), ("next_trigger_at", "__next")):
        rows = rows.withColumn(name, F.when(F.col("__planned"), F.col(value)).otherwise(F.col(name)))
    return rows.select(*schedules.columns)


def feedback(schedules: DataFrame, finished: DataFrame) -> DataFrame:
    """`schedules` whose executions finished (schedule_id, end_at) with the latest end as last_feedback_at."""
    last = finished.groupBy("schedule_id").agg(F.max("end_at").alias("__end"))
    return schedules.join(last, "schedule_id", "left").withColumn("last_feedback_at", F.coalesce("__end", "last_feedback_at")).select(*schedules.columns)


def config_errors() -> Column:
    """Codes of what a schedule lacks."""
    need = lambda cond, code: F.when(cond, F.lit(code))
    blank = F.coalesce(F.trim("schedule_cron"), F.lit("")) == ""
    interval = F.coalesce(F.col("schedule_interval"), F.lit(0)) <= 0
    return F.array_compact(
        F.array(
            need((F.col("schedule_type") == "cron") & blank, "cron_missing"),
            need(F.col("schedule_type").isin("fixed_rate", "fixed_delay") & interval, "interval_missing"),
            need(~F.coalesce(F.col("schedule_type").isin("fixed_rate", "fixed_delay", "cron"), F.lit(False)), "type_unknown"),
        )
    )


def changed_schedules(old: DataFrame, new: DataFrame) -> DataFrame:
    """schedule_id of schedules that are new or whose fingerprint changed."""
    both = new.join(old.select("schedule_id", F.col("fingerprint").alias("was")), "schedule_id", "left")
    return both.filter(F.col("was").isNull() | (F.col("was") != F.col("fingerprint"))).select("schedule_id")


def replan(old: DataFrame, new: DataFrame, firings: DataFrame) -> DataFrame:
    """Firings left after schedules were saved: initial firings of changed or new schedules go (fingerprint column).

    Each row is judged by its own status, so of rows that share a delay_id only the initial ones go; null statuses and schedules stay.
    """
    of_changed = (F.col("schedule_id") == F.col("__changed")) & (F.col("status") == "init")
    return firings.join(changed_schedules(old, new).select(F.col("schedule_id").alias("__changed")), of_changed, "left_anti")


def save(old: DataFrame, new: DataFrame, firings: DataFrame, now: str, ahead_seconds: int = 600) -> tuple[DataFrame, DataFrame]:
    """Schedules and firings (delay_id, schedule_id, trigger_at, status) after `new` schedules were saved: what replan leaves,
    and the firings that the changed ones are planned anew for, in state init; a delay_id that is left is not made again."""
    planned = plan_firings(new.join(changed_schedules(old, new), "schedule_id", "left_semi"), now, ahead_seconds)
    left = replan(old, new, firings).select("delay_id", "schedule_id", "trigger_at", "status")
    return carried(new, planned), left.unionByName(firings_of(planned).join(left.select("delay_id"), "delay_id", "left_anti"))
