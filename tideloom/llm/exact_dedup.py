"""Exact dedup against a persistent digest index that is bucketed and sorted by hash."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_split_join, materialize, shuffle_partitions, work_table, write_sorted_buckets

#: ASCII white space, runs of which count as one space.
WHITE = r"[\x20\x09-\x0D]+"


def digest_keys(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, SHA-256 digest of the normalised text and a number of each row, as a written table; texts go no further."""
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " ")
    return materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")


def by_id(keys: DataFrame, batches: int) -> list[DataFrame]:
    """`keys` in batches of ascending doc_id, rows without one last: so the first batch that has a text has its least id."""
    shares = [k / batches for k in range(1, batches)]
    cuts = [int(c) for c in sorted(set(keys.approxQuantile("doc_id", shares, 0.01)))] if shares else []
    if not cuts:
        return [keys]
    middle = [keys.filter((F.col("doc_id") > lo) & (F.col("doc_id") <= hi)) for lo, hi in zip(cuts, cuts[1:])]
    return [keys.filter(F.col("doc_id") <= cuts[0]), *middle, keys.filter(F.col("doc_id").isNull() | (F.col("doc_id") > cuts[-1]))]


class DigestIndex:
    """SHA-256 digests of all texts seen so far in a table bucketed and sorted by digest.

    `add` groups a batch by digest (32-byte digests and ids are all that is shuffled) and sort-merge-anti-joins it with the
    index, whose side is not shuffled: what is left is new and is appended with the row that stays; of texts seen before only
    the number of further rows is. Rows of a batch count from when it is published, as the last step: a batch that was
    lost before may be added again, and a batch id that was published gives its first answer again, since a batch is
    compared with those before it alone.

    Defined cases: null text counts as empty. Within a batch the least doc_id stays, a null one only if there is no other;
    an earlier batch's row stays whatever ids come later. Of rows that repeat both text and doc_id exactly one stays; an
    empty batch adds nothing and has an empty result; other columns of a batch are ignored.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or work_table(spark, "digest_index")
        self.buckets = buckets or max(8, shuffle_partitions(spark))

    def published(self) -> dict[str, str]:
        """The attempt that counts for each batch id: one short row for each call."""
        name = f"{self.name}_batches"
        if not self.spark.catalog.tableExists(name):
            return {}
        return {r["batch"]: r["attempt"] for r in self.spark.table(name).orderBy("number").collect()}

    def publish(self, batch: str, attempt: str) -> None:
        rows = self.spark.createDataFrame([(batch, attempt, time.time_ns())], "batch string, attempt string, number long")
        rows.coalesce(1).write.mode("append").saveAsTable(f"{self.name}_batches")

    def _rows(self, attempts: list[str]) -> DataFrame | None:
        return self.spark.table(self.name).filter(F.col("attempt").isin(attempts)) if attempts else None

    def rows(self) -> DataFrame | None:
        """digest, keep_id, keep_row of each distinct text."""
        found = self._rows(list(self.published().values()))
        return found if found is None else found.filter("keep_row IS NOT NULL").select("digest", "keep_id", "keep_row")

    def entries(self, attempts: list[str] | None = None) -> DataFrame:
        """digest, keep_id, keep_row, group_size over all batches, or those attempts."""
        found = self._rows(list(self.published().values()) if attempts is None else attempts)
        if found is None:
            return self.spark.createDataFrame([], "digest binary, keep_id long, keep_row long, first string, group_size long")
        new = F.col("keep_row").isNotNull()
        return found.groupBy("digest").agg(
            F.max(F.when(new, F.col("keep_id"))).alias("keep_id"), F.max("keep_row").alias("keep_row"), F.max(F.when(new, F.col("attempt"))).alias("first"), F.sum("n").alias("group_size")
        )

    def _add(self, keys: DataFrame, batch: str) -> tuple[str, list[str], DataFrame]:
        # Plain longs, so that groups are hashed; rows that tie in text and id are alike, so any of them may stay.
        order = F.coalesce("doc_id", F.lit(2**63 - 1))
        first = [F.min("doc_id").alias("keep_id"), F.min_by("row", order).alias("keep_row"), F.count(F.lit(1)).alias("n")]
        groups = materialize(keys.groupBy("digest").agg(*first), "digest_groups")
        known = self.published()  # in the order of first publication
        before, attempt = [known[b] for b in list(known)[: list(known).index(batch) if batch in known else None]], uuid.uuid4().hex
        seen = self._rows(before)
        added = groups
        if seen is not None:
            known = seen.filter("keep_row IS NOT NULL").select("digest")
            again = groups.join(known, "digest", "left_semi").select("digest", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("keep_row"), "n")
            added = groups.join(known, "digest", "left_anti").unionByName(again)
        write_sorted_buckets(added.withColumn("attempt", F.lit(attempt)), self.name, ["digest"], self.buckets, append=self.spark.catalog.tableExists(self.name))
        return attempt, [*before, attempt], groups

    def add(self, keys: DataFrame, batch: str) -> None:
        """Takes in rows of digest_keys under a batch id."""
        attempt, _, _ = self._add(keys, batch)
        self.publish(batch, attempt)

    def dedup(self, docs: DataFrame, batch: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """One row per row of `docs`, a new batch: doc_id, keep_id, group_size (so far, this batch included), kept,
        text_sha256, row. It is written before the batch is published."""
        keys, batch = digest_keys(docs, text, doc_id), batch or uuid.uuid4().hex
        attempt, attempts, groups = self._add(keys, batch)
        own = self.entries(attempts).join(groups.select("digest", F.col("n").alias("own")), "digest")
        own = materialize(own.withColumn("fresh", F.col("first") == attempt).drop("first"), "digest_found")
        total = groups.agg(F.sum("n")).first()[0] or 0
        result = materialize(resolved(keys, own, "own", total), "digest_result")
        self.publish(batch, attempt)
        return result

    def new_only(self, docs: DataFrame, batch: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """The rows of `docs` that stay, with all their columns. Needs ids without repeats; repeated ids with one text give one row."""
        kept = self.dedup(docs, batch, text, doc_id).filter("kept").select(F.col("doc_id").alias("__kept"), F.col("text_sha256").alias("__sha"))
        normal = F.sha2(F.regexp_replace(F.coalesce(docs[text], F.lit("")), WHITE, " "), 256)
        marked = docs.withColumn("__sha", normal)
        same = marked[doc_id].eqNullSafe(kept["__kept"]) & (marked["__sha"] == kept["__sha"])
        return marked.join(kept, same, "left_semi").drop("__sha").dropDuplicates([doc_id, text])

    def drop(self) -> None:
        """Removes the index with its files."""
        for name in (self.name, f"{self.name}_batches"):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def resolved(keys: DataFrame, entries: DataFrame, size: str, total: int) -> DataFrame:
    """The rows of `keys` with what `entries` (written, one row per digest) say of their digest."""
    joined = hot_split_join(keys, entries, ["digest"], size, total)
    kept = (F.col("row") == F.col("keep_row")) & (F.col("fresh") if "fresh" in entries.columns else F.lit(True))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row")


def dedup_all(docs: DataFrame, batches: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of a whole table, as of DigestIndex.dedup, through a new index that takes it in `batches` by doc_id.

    keep_id is the least doc_id of all equal texts, as batches ascend; group_size counts all rows. The index is dropped.
    """
    spark, keys = docs.sparkSession, digest_keys(docs, text, doc_id)
    index = DigestIndex(spark)
    for k, part in enumerate(by_id(keys, batches)):
        index.add(part, str(k))
    entries = materialize(index.entries().drop("first"), "digest_entries")
    index.drop()
    return resolved(keys, entries, "group_size", keys.count())


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_all(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")


OP10_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM n
"""
