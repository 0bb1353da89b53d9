"""Line dedup on levelled sorted runs of line hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, hot_left_join, hot_split_join, materialize, shared_dir, shuffle_partitions, table_path, work_table, write_sorted_buckets

#: White space stripped from a line's ends for its key.
STRIP = b" \t\n\x0b\x0c\r"
KEYS = ["h1", "h2"]
RUN = "h1 long, h2 long, n_docs long, last long"


def line_keys(text: str, least: int) -> list[bytes | None]:
    """The key of each line, None for keys of fewer than `least` code points. Lower-cases A-Z only."""
    keys = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(STRIP).lower()
        n = len(key)
        keys.append(key if n >= 4 * least or n >= least and len(key.decode("utf-8", "surrogatepass")) >= least else None)
    return keys


def _hashes(keys: list[bytes]):
    """128-bit hashes as two signed 64-bit columns."""
    import numpy as np
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, keys)), ">i8").reshape(-1, 2).astype("i8")


def _line_rows(least: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, n = [], []
            for text in b["text"]:
                own = {k for k in line_keys(text or "", least) if k is not None}
                keys.extend(own)
                n.append(len(own))
            h = _hashes(keys)
            yield pd.DataFrame({"did": b["did"].repeat(n), "hash": b["hash"].repeat(n)}).assign(h1=h[:, 0], h2=h[:, 1])

    return rows


def _keep_lines(least: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from hashlib import sha256

        for b in batches:
            kept, total, dropped = [], [], []
            for text, drop in zip(b["text"], b["drop"]):
                text = text or ""
                n = text.count("\n") + 1
                gone = 0
                if drop is not None and len(drop):
                    bad, lines, keys = set(drop.tolist()), text.split("\n"), line_keys(text, least)
                    own = [k for k in keys if k is not None]
                    h = iter(_hashes(own)[:, 0].tolist())
                    stay = [line for line, k in zip(lines, keys) if k is None or next(h) not in bad]
                    gone, text = n - len(stay), "\n".join(stay)
                kept.append(text)
                total.append(n)
                dropped.append(gone)
            out = b.drop(columns=["text", "drop"]).assign(n_lines=total, n_dropped=dropped)
            yield out.assign(kept_text=kept, kept_sha256=[sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in kept])

    return rows


class LineRuns:
    """Line hashes in sorted runs by level, as a log-structured store.

    `add` pre-aggregates a batch to one row per hash and merge-anti-joins it with the runs, which are bucketed and sorted
    alike and so are not shuffled: what no run has becomes a run of level 0; what a run has is a delta beside them, with
    what that run knows. `fan_in` runs of a level are merged into one of the next. So a hash is in one run at most, and
    only hashes that were seen again, or are common in one batch, need be looked at for their totals.
    A document's lines must come in one batch.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_in: int = 3):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or max(8, shuffle_partitions(spark))
        self.levels: list[list[str]] = [[]]
        self.deltas: list[DataFrame] = []

    def _write(self, df: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        table = work_table(self.spark, f"line_run_{level}")
        write_sorted_buckets(df, table, KEYS, self.buckets)
        self.levels[level].append(table)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def add(self, lines: DataFrame) -> None:
        """lines: did, h1, h2, one row per document and hash."""
        stats = lines.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_docs"), F.max("did").alias("last"))
        if runs := self.runs():
            stats = materialize(stats.repartition(self.buckets, *KEYS), "line_batch")
            known = [r.select(*KEYS, F.col("n_docs").alias("run_docs"), F.col("last").alias("run_last")) for r in runs]
            self.deltas.append(materialize(reduce(DataFrame.unionByName, [stats.join(r, KEYS) for r in known]), "line_again"))
            stats = reduce(lambda x, r: x.join(r, KEYS, "left_anti"), known, stats)
        self._write(stats, 0)
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            old, self.levels[level] = self.levels[level], []
            # Read as plain files: Spark takes a union of bucketed scans for co-partitioned, yet puts their partitions one
            # behind another.
            self._write(reduce(DataFrame.unionByName, [self.spark.read.schema(RUN).parquet(table_path(self.spark, t)) for t in old]), level + 1)
            for t in old:
                self.spark.sql(f"DROP TABLE {t}")
            level += 1

    def repeated(self, least_docs: int) -> DataFrame:
        """h1, h2, n_docs, last over all batches of the hashes in at least `least_docs` documents."""
        own = [*KEYS, "n_docs", "last"]
        common = [r.filter(F.col("n_docs") >= least_docs).select(*own) for r in self.runs()]
        if not self.deltas:
            return reduce(DataFrame.unionByName, common)
        sums = [F.sum("n_docs") + F.max("run_docs"), F.greatest(F.max("last"), F.max("run_last"))]
        again = materialize(reduce(DataFrame.unionByName, self.deltas).groupBy(*KEYS).agg(*(c.alias(n) for c, n in zip(sums, own[2:]))), "line_totals")
        only = [c.join(again.select(*KEYS), KEYS, "left_anti") for c in common]
        return reduce(DataFrame.unionByName, [again.filter(F.col("n_docs") >= least_docs).select(*own), *only])

    def drop(self) -> None:
        """Removes all runs with their files."""
        for t in (t for level in self.levels for t in level):
            self.spark.sql(f"DROP TABLE {t}")
        self.levels = [[]]


def drop_repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = 3, fan_in: int = 3) -> DataFrame:
    """Drop lines whose key is in at least `least_docs` documents, except in the largest doc_id that holds it.

    Returns doc_id, kept_text, n_lines, n_dropped, kept_sha256 per row of `docs`, which needs doc_id and text.
    The documents go into the runs in `batches` batches by a hash of doc_id. A row meets its dropped lines by doc_id and
    text hash, so rows without an id are not one task's work; rows that repeat both very often are not shuffled.

    Defined cases: null text is one empty line; rows that share a doc_id count as one document; null doc_ids count as
    one document smaller than all others; a document that loses all lines keeps the empty text; other columns are ignored.
    """
    spark = docs.sparkSession
    if docs.schema["doc_id"].dataType.typeName() == "void":
        raise TypeError("doc_id needs a type")
    # The smallest long stands in for a null id, so that joins and maxima see it.
    did, hash_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64("text").alias("hash")
    own = docs.select("doc_id", did, hash_, "text")
    lines = own.select("did", "hash", "text").mapInPandas(_line_rows(least_chars), "did long, hash long, h1 long, h2 long")
    path = shared_dir(spark, "lines")
    lines.withColumn("batch", F.pmod(F.xxhash64("did"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("did long, hash long, h1 long, h2 long, batch int").parquet(path)
    store = LineRuns(spark, fan_in=fan_in)
    for k in range(batches):
        store.add(lines.filter(F.col("batch") == k).select("did", *KEYS).distinct())
    repeated = materialize(store.repeated(least_docs), "repeated")
    store.drop()
    held = hot_split_join(lines.select("did", "hash", *KEYS), repeated, KEYS, "n_docs", lines.count()).filter("did <> last")
    drop = held.groupBy("did", "hash").agg(F.collect_set("h1").alias("drop"))
    # Copies of a row are seen by how often its id and text come, which few do more than once.
    often = own.groupBy("did", "hash").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    drop = materialize(drop.join(often, ["did", "hash"], "left").withColumn("rows", F.coalesce("rows", F.lit(1))), "line_drops")
    joined = hot_left_join(own, drop, ["did", "hash"], "rows", max(HOT_SHARE * 2, docs.count())).select("doc_id", "text", "drop")
    return joined.mapInPandas(_keep_lines(least_chars), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_lines long, n_dropped long, kept_text string, kept_sha256 string")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_repeated_lines(docs).drop("kept_text")


OP1_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS dropped FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
