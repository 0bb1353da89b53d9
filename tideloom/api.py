"""Verbs of the console and of workers as functions of tables: each takes state as DataFrames and returns it changed.

Headers are (id, name, description, publish_version, draft_version, is_enabled, is_deleted); versions are
(ref_id, ref_type, version, description, config).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import filters, joins, scans, temporal, transitions
from .operators.aggregates import latest_version
from .operators.scans import PAGE
from .sources.files import next_ids

HEADER = "id long, name string, description string, publish_version string, draft_version string, is_enabled boolean, is_deleted boolean"
VERSION = "ref_id long, ref_type string, version string, description string, config string"


def create(headers: DataFrame, new: DataFrame) -> DataFrame:
    """Adds headers (name, description) with ids above all others, disabled; numbered by partition, not in one task."""
    top = headers.agg(F.coalesce(F.max("id"), F.lit(10_000))).first()[0]
    rows = next_ids(headers.sparkSession, top, new.select("name", "description"), step=1).select(
        "id", "name", "description", F.lit(None).cast("string").alias("publish_version"),
        F.lit(None).cast("string").alias("draft_version"), F.lit(False).alias("is_enabled"), F.lit(False).alias("is_deleted"),
    )
    return headers.unionByName(rows)


def update(headers: DataFrame, changed: DataFrame) -> DataFrame:
    """Name and description of changed rows (id, name, description) that exist and are not deleted."""
    c = changed.select("id", F.col("name").alias("__name"), F.col("description").alias("__description"), F.lit(True).alias("__new"))
    live = F.coalesce("__new", F.lit(False)) & ~F.col("is_deleted")
    joined = headers.join(c, "id", "left")
    for k in ("name", "description"):
        joined = joined.withColumn(k, F.when(live, F.col(f"__{k}")).otherwise(F.col(k)))
    return joined.select(*headers.columns)


def _mark(headers: DataFrame, ids: list[int], **values: bool) -> DataFrame:
    chosen = F.col("id").isin(ids) & ~F.col("is_deleted")
    for k, v in values.items():
        headers = headers.withColumn(k, F.when(chosen, F.lit(v)).otherwise(F.col(k)))
    return headers


def enable(headers: DataFrame, *ids: int) -> DataFrame:
    return _mark(headers, list(ids), is_enabled=True)


def disable(headers: DataFrame, *ids: int) -> DataFrame:
    return _mark(headers, list(ids), is_enabled=False)


def delete(headers: DataFrame, firings: DataFrame, *ids: int) -> tuple[DataFrame, DataFrame]:
    """Headers marked deleted and disabled; their initial firings go."""
    gone = F.col("schedule_id").isin(list(ids)) & (F.col("status") == "init")
    return _mark(headers, list(ids), is_enabled=False, is_deleted=True), firings.filter(~F.coalesce(gone, F.lit(False)))


def draft(headers: DataFrame, versions: DataFrame, drafts: DataFrame, ref_type: str) -> tuple[DataFrame, DataFrame]:
    """Saves drafts (ref_id, description, config) as the next version of each ref, which headers then point to."""
    known = latest_version(versions.filter(F.col("ref_type") == ref_type)).select("ref_id", "next")
    rows = drafts.join(known, "ref_id", "left").select("ref_id", F.lit(ref_type).alias("ref_type"), F.coalesce("next", F.lit(1)).cast("string").alias("version"), "description", "config")
    points = rows.select(F.col("ref_id").alias("id"), F.col("version").alias("__draft"))
    headers = headers.join(points, "id", "left").withColumn("draft_version", F.coalesce("__draft", "draft_version")).select(*headers.columns)
    return headers, versions.unionByName(rows)


def publish(headers: DataFrame, *ids: int) -> DataFrame:
    chosen = F.col("id").isin(list(ids))
    return transitions.publish(headers.filter(chosen)).unionByName(headers.filter(~chosen))


def page(headers: DataFrame, current: int = 1, size: int = PAGE, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a page, by id descending, and its total and has_next."""
    rows = scans.name_like(scans.lookup(headers), "name", name)
    return scans.page(rows, current, size, key="id"), scans.page_info(rows, current, size)


def get(headers: DataFrame, versions: DataFrame, id: int, mode: str = "PUBLISH_FIRST") -> DataFrame:
    """A header with the config of the version that the mode chooses, null without one."""
    h = scans.lookup(headers, id=id).withColumn("version", filters.version_of(mode))
    return h.join(versions.select(F.col("ref_id").alias("id"), "version", "config"), ["id", "version"], "left")


def register(workers: DataFrame, tags: DataFrame, new: DataFrame, new_tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Workers and their tags with those of the new ones replaced; an id that exists is taken over."""
    return joins.replace_by_key(workers, new, ["worker_id"]), joins.replace_by_key(tags, new_tags, ["ref_id", "ref_type"])


def heartbeat(metrics: DataFrame, beats: DataFrame) -> DataFrame:
    """The latest metric of each worker."""
    return joins.upsert(metrics, beats, ["worker_id"], "last_heartbeat_at")


def report(jobs: DataFrame, reports: DataFrame) -> DataFrame:
    """Jobs after their reports (job_id, event, worker_address and, if there may be several of a job, at): guarded, only from
    the worker that holds the job, one after another in order of `at`, event and address. A job without a worker goes to the
    first that gets it to change."""
    order = ["at"] if "at" in reports.columns else []
    own = reports.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(*order, "event", F.col("worker_address").alias("from")))).alias("__reports"))
    start = F.struct(F.col("status"), F.col("worker_address").alias("worker"))

    def step(state: Column, r: Column) -> Column:
        owns = F.coalesce(state["worker"].isNull() | (state["worker"] == r["from"]), F.lit(False))
        new = F.when(owns, transitions.next_state(state["status"], r["event"], transitions.JOB_EVENTS)).otherwise(state["status"])
        return F.struct(new.alias("status"), F.when(new != state["status"], F.coalesce(state["worker"], r["from"])).otherwise(state["worker"]).alias("worker"))

    done = jobs.join(own, "job_id", "left").withColumn("__state", F.aggregate(F.coalesce("__reports", F.array().cast(own.schema["__reports"].dataType)), start, step))
    return done.withColumn("status", F.col("__state.status")).withColumn("worker_address", F.col("__state.worker")).select(*jobs.columns)


def enable_schedules(schedules: DataFrame, firings: DataFrame, now: str, *ids: int) -> tuple[DataFrame, DataFrame]:
    """Schedules enabled and planned at once; a firing (by delay_id) that is there already is not made again."""
    chosen = F.col("schedule_id").isin(list(ids))
    on = schedules.withColumn("is_enabled", F.when(chosen, F.lit(True)).otherwise(F.col("is_enabled")))
    planned = temporal.plan_firings(on.filter(chosen), now)
    new = temporal.firings_of(planned).join(firings.select("delay_id"), "delay_id", "left_anti")
    return temporal.carried(on, planned), firings.select(*new.columns).unionByName(new)


def disable_schedules(schedules: DataFrame, *ids: int) -> DataFrame:
    """Schedules disabled; their firings stay and are dropped when they are due."""
    return schedules.withColumn("is_enabled", F.when(F.col("schedule_id").isin(list(ids)), F.lit(False)).otherwise(F.col("is_enabled")))


def page_of(rows: DataFrame, key: str, current: int = 1, size: int = PAGE, **equal) -> tuple[DataFrame, DataFrame]:
    """A page of apps, executions or workers, by key descending, whose columns have these values; None is no condition."""
    found = scans.lookup(rows, **{k: v for k, v in equal.items() if v is not None})
    return scans.page(found, current, size, key=key), scans.page_info(found, current, size)


def get_by(rows: DataFrame, **key) -> DataFrame:
    """The app, execution or worker of a key that is not deleted."""
    return scans.lookup(rows, **key)
