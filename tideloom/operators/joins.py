"""Joins of the scheduler: hydration, idempotent creation, ownership, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import BUCKETS


def hydrate_workers(workers: DataFrame, executors: DataFrame, tags: DataFrame, metrics: DataFrame) -> DataFrame:
    """Workers with arrays of executors and tags, sorted, and their metric. Sides are grouped before they are joined."""
    e = executors.groupBy("worker_id").agg(F.array_sort(F.collect_set("name")).alias("executors"))
    own = tags.filter("ref_type = 'worker'").groupBy(F.col("ref_id").alias("worker_id"))
    t = own.agg(F.array_sort(F.collect_list(F.struct(F.col("tag_name").alias("name"), F.col("tag_value").alias("value")))).alias("tags"))
    return workers.join(e, "worker_id", "left").join(t, "worker_id", "left").join(metrics, "worker_id", "left")


def create_missing(existing: DataFrame, wanted: DataFrame, key: list[str], order: list[Column] | None = None) -> DataFrame:
    """Wanted rows whose key does not exist yet, one for each key (the first in order). Key columns must not be null."""
    w = Window.partitionBy(*key).orderBy(*(order or [F.col(c) for c in wanted.columns if c not in key] or [F.col(key[0])]))
    new = wanted.join(existing.select(*key), key, "left_anti")
    return new.withColumn("__place", F.row_number().over(w)).filter("__place = 1").drop("__place")


def get_or_create(existing: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows and the missing ones."""
    return existing.unionByName(create_missing(existing, wanted, key).select(*existing.columns))


def missing_buckets(buckets: DataFrame, n: int = BUCKETS) -> DataFrame:
    return buckets.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("bucket")).join(buckets, "bucket", "left_anti")


def orphan_buckets(buckets: DataFrame, alive: DataFrame) -> DataFrame:
    """Buckets whose broker is not alive."""
    return buckets.join(alive.select("broker_id"), "broker_id", "left_anti").select("bucket", "broker_id")


def rebalance(buckets: DataFrame, alive: DataFrame, self_id: int, n: int = BUCKETS) -> DataFrame:
    """All buckets with their broker: an orphan b goes to the alive broker at place b % number in order, a missing one to self.

    Brokers and buckets are few by definition, so the sorted brokers are one row.
    """
    ring = alive.agg(F.array_sort(F.collect_set("broker_id")).alias("ring"))
    orphans = orphan_buckets(buckets, alive).crossJoin(F.broadcast(ring)).select("bucket", F.element_at("ring", (F.col("bucket") % F.size("ring") + 1).cast("int")).alias("broker_id"))
    kept = buckets.join(alive.select("broker_id"), "broker_id", "left_semi").select("bucket", "broker_id")
    return kept.unionByName(orphans).unionByName(missing_buckets(buckets, n).withColumn("broker_id", F.lit(self_id).cast(buckets.schema["broker_id"].dataType)))


def replace_by_key(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """`rows` with all rows of new's keys replaced by those of `new`."""
    return rows.join(new.select(*key).distinct(), key, "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))


def upsert(rows: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """The latest row of each key by `version`, of both tables."""
    both = rows.unionByName(new.select(*rows.columns))
    return both.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), version).alias("r")).select("r.*")
