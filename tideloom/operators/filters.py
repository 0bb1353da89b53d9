"""Predicates on workers and firings, and projections of versioned headers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import non_blank


@dataclass(frozen=True)
class TagFilter:
    name: str
    condition: str
    value: str | None = None

    def column(self, tags: str = "tags") -> Column:
        """The condition on an array of (name, value); no tags count as none. An unknown condition is false."""
        own = F.coalesce(F.col(tags), F.array().cast("array<struct<name:string,value:string>>"))
        named = F.exists(own, lambda t: t["name"] == self.name)
        equal = F.exists(own, lambda t: (t["name"] == self.name) & t["value"].eqNullSafe(F.lit(self.value)))
        return {
            "EXISTS": named,
            "NOT_EXISTS": ~named,
            "MUST_MATCH_VALUE": equal,
            "MUST_NOT_MATCH_VALUE": named & ~equal,
            "MUST_MATCH_VALUE_REGEX": F.exists(own, lambda t: (t["name"] == self.name) & t["value"].rlike(self.value or "")),
        }.get(self.condition, F.lit(False))


def with_tags(workers: DataFrame, filters: list[TagFilter]) -> DataFrame:
    """Workers that meet all filters; all of them for none."""
    for f in filters:
        workers = workers.filter(f.column())
    return workers


def with_executor(workers: DataFrame, name: str) -> DataFrame:
    return workers.filter(F.array_contains(F.coalesce("executors", F.array().cast("array<string>")), name))


def with_resources(workers: DataFrame, cpu: float | None = None, memory: int | None = None) -> DataFrame:
    """Workers with room in their queue and, where asked for, at least that load figure and memory. Without metrics: none."""
    ok = F.col("available_queue_num") > 0
    if cpu is not None:
        ok &= F.col("cpu_load") >= cpu
    if memory is not None:
        ok &= F.col("free_memory") >= memory
    return workers.filter(F.coalesce(ok, F.lit(False)))


def available(workers: DataFrame) -> DataFrame:
    return workers.filter((F.col("status") == "online") & F.col("is_enabled") & ~F.col("is_deleted"))


def in_window(rows: DataFrame, now: str, ahead_seconds: int = 600) -> DataFrame:
    """Rows whose trigger_at is neither before now or their start nor after their end or the look-ahead."""
    at = F.expr(f"TIMESTAMP_NTZ '{now}'")
    return rows.filter(F.col("trigger_at").between(F.greatest(at, F.col("start_time")), F.least(F.col("end_time"), at + F.expr(f"INTERVAL {ahead_seconds} SECONDS"))))


def version_of(mode: str, publish: str = "publish_version", draft: str = "draft_version") -> Column:
    """The version a header points to: PUBLISH, DRAFT, PUBLISH_FIRST, DRAFT_FIRST; null for any other mode."""
    p, d = non_blank(F.col(publish)), non_blank(F.col(draft))
    return {"PUBLISH": p, "DRAFT": d, "PUBLISH_FIRST": F.coalesce(p, d), "DRAFT_FIRST": F.coalesce(d, p)}.get(mode, F.lit(None).cast("string"))


def parameters(column: str | Column = "params", prefix: str = "worker.lb.") -> Column:
    """Entries of a map whose key has the prefix and more, without it; null values go."""
    kept = F.map_filter(F.col(column) if isinstance(column, str) else column, lambda k, v: k.startswith(prefix) & (F.length(F.trim(k)) > len(prefix)) & v.isNotNull())
    return F.transform_keys(kept, lambda k, _: F.substring(k, len(prefix) + 1, 1 << 20))


def parse_tags(column: str) -> Column:
    """(name, value) of `key=value` texts in an array; those without a key or value go, repeats too."""
    split = F.transform(F.col(column), lambda x: F.split(x, "="))
    kept = F.filter(split, lambda p: (F.size(p) >= 2) & (F.trim(p[0]) != "") & (F.trim(p[1]) != ""))
    return F.array_distinct(F.transform(kept, lambda p: F.struct(F.trim(p[0]).alias("name"), F.trim(p[1]).alias("value"))))
