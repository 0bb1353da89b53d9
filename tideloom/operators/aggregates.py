"""Aggregations: counts, progress, outcomes, access statistics, digests, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def progress(jobs: DataFrame, key: str) -> DataFrame:
    """total, success, fail and finished of each key."""
    got = jobs.groupBy(key).agg(F.count(F.lit(1)).alias("total_num"), F.count_if(F.col("status") == "succeed").alias("success_num"), F.count_if(F.col("status") == "failed").alias("fail_num"))
    return got.withColumn("finished", F.col("total_num") == F.col("success_num") + F.col("fail_num"))


def outcome(progressed: DataFrame, any_of: bool = False) -> DataFrame:
    """running until finished; then failed on any failure or, any_of, only without a success."""
    ok = F.col("success_num") > 0 if any_of else F.col("fail_num") == 0
    return progressed.withColumn("outcome", F.when(~F.col("finished"), "running").when(ok, "succeed").otherwise("failed"))


def access_statistics(servers: DataFrame, log: DataFrame, now: str, minutes: int) -> DataFrame:
    """Of each server: accesses and last one in the interval before now; 0 and null without any."""
    end = F.expr(f"TIMESTAMP_NTZ '{now}'")
    recent = log.filter((F.col("dispatch_at") > end - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("dispatch_at") <= end))
    counts = recent.groupBy("server_id").agg(F.count(F.lit(1)).alias("accesses"), F.max("dispatch_at").alias("last_at"))
    return servers.join(counts, "server_id", "left").withColumn("accesses", F.coalesce("accesses", F.lit(0)))


def topology_digest(brokers: DataFrame, id: str = "broker_id") -> DataFrame:
    """MD5 of the sorted, comma-joined ids: changes when the set of brokers does. For sets as small as brokers'."""
    ids = F.array_sort(F.collect_list(F.col(id).cast("string")))
    return brokers.agg(F.md5(F.array_join(ids, ",")).alias("version"), F.count(F.lit(1)).alias("brokers"))


def latest_version(versions: DataFrame) -> DataFrame:
    """Largest version as a number and the next one, of each ref."""
    top = F.max(F.col("version").cast("long"))
    return versions.groupBy("ref_id", "ref_type").agg(top.alias("latest"), (top + 1).alias("next"))


def map_of_results(tasks: DataFrame, job: str, task: str, result: str) -> DataFrame:
    """task -> result of each job, which has a bounded number of tasks; the last in order of repeated tasks."""
    one = tasks.groupBy(job, task).agg(F.max(result).alias(result))
    return one.groupBy(job).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(task, result)))).alias("results"))
