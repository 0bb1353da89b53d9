"""Heartbeats, access windows and report state machines as streams."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.transitions import JOB_EVENTS, states_of


def read_stream(spark: SparkSession, folder: str, name: str, like: DataFrame, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the parquet file or folder of files `name` in a folder, with the schema of a batch read of it."""
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger)
    if any(f.rstrip("/").endswith(f"/{name}") for f in like.inputFiles()[:1]):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(f"{folder}/{name}")


def drain(stream: DataFrame, path: str, mode: str = "append", key: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there into a folder: appended rows, or (mode update) the last row of each key.

    Restarts from its checkpoint in the same folder. `update` writes each batch's changed rows under the batch's number, so
    a batch that runs again replaces its own; the latest batch of a key counts. State is bounded by the stream's watermark.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint")
    if mode == "append":
        q = writer.format("parquet").option("path", f"{path}/data").start()
    else:
        q = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/data/batch={n}")).start()
    q.awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(f"{path}/data")
    if q.lastProgress is None:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/data")
    return rows.groupBy(*key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("r")).select("r.*")


def online_windows(beats: DataFrame, seconds: int = 10, late: str = "1 day") -> DataFrame:
    """Heartbeats of each node in tumbling windows."""
    w = F.window(F.col("at").cast("timestamp"), f"{seconds} seconds")
    counted = beats.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late).groupBy("node_id", w.alias("w")).agg(F.count(F.lit(1)).alias("beats"))
    return counted.select("node_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "beats")


def access_windows(log: DataFrame, minutes: int = 10, slide: int = 5, retention: str = "12 hours") -> DataFrame:
    """Accesses of each server in sliding windows; rows later than the retention are dropped with its state."""
    w = F.window("dispatch_at", f"{minutes} minutes", f"{slide} minutes")
    counted = log.withColumn("dispatch_at", F.col("dispatch_at").cast("timestamp")).withWatermark("dispatch_at", retention).groupBy("server_id", w.alias("w"))
    return counted.agg(F.count(F.lit(1)).alias("accesses")).select("server_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "accesses")


def last_seen(beats: DataFrame) -> DataFrame:
    """Latest heartbeat and number of heartbeats of each node: a few bytes of state a node."""
    return beats.groupBy("node_id").agg(F.max("at").alias("last_at"), F.count(F.lit(1)).alias("beats"))


def offline(seen: DataFrame, now: str, timeout_seconds: int = 10) -> DataFrame:
    """Nodes silent for longer than the timeout."""
    return seen.filter(F.col("last_at") < F.expr(f"TIMESTAMP_NTZ '{now}' - INTERVAL {timeout_seconds} SECONDS"))


def online_spells(beats: DataFrame, timeout_seconds: int = 10, late: str = "1 hour") -> DataFrame:
    """node_id, online_at, last_at, offline_at, beats: each spell in which no two heartbeats of a node are further apart than
    the timeout, once event time has passed its end by `late`. So a node is found offline by event time, not by a clock.

    Append mode: a spell is sent once and its state is then dropped. A spell that may go on is not sent; heartbeats without a
    time count for nothing.
    """
    timed = beats.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    w = F.session_window("at", f"{timeout_seconds} seconds")
    spells = timed.groupBy("node_id", w.alias("w")).agg(F.max("at").alias("last_at"), F.count(F.lit(1)).alias("beats"))
    times = {"online_at": "w.start", "last_at": "last_at", "offline_at": "w.end"}
    return spells.select("node_id", *(F.col(c).cast("timestamp_ntz").alias(k) for k, c in times.items()), "beats")


def first_reports(log: DataFrame, key: list[str], at: str, within: str = "30 days") -> DataFrame:
    """Each key once: repeated deliveries are dropped."""
    return log.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark(key)


def _composed(keys: np.ndarray, to: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each run of equal keys its rows' maps in order, composed: rows x states, where a row leads and how many events apply.

    Neighbours are composed in pairs until each key has one row, so the work is linear and a long run takes few rounds.
    """
    while len(keys):
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        place = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
        if not place.any():
            break
        odd = np.flatnonzero(place % 2)
        via = to[odd - 1]
        n[odd - 1] += np.take_along_axis(n[odd], via, 1)
        to[odd - 1] = np.take_along_axis(to[odd], via, 1)
        kept = place % 2 == 0
        keys, to, n = keys[kept], to[kept], n[kept]
    return to, n


def report_states(log: DataFrame, key: str = "job_id", events: Mapping = JOB_EVENTS, initial: str = "inited") -> DataFrame:
    """Status of each key after its reports so far, guarded as in fold_events, kept as state between batches.

    log: key, at, event_id, event. Reports of a batch are taken in order of (at, event_id): they are dealt by range, each
    partition folds its reports of all keys to maps over the states, and a key composes those few maps.
    """
    states = states_of(events, initial)
    names = list(events)
    # A row for each event and, last, one for others, which change nothing: where it leads from each state.
    leads = np.array([[states.index(events[e][1]) if s in events[e][0] else i for i, s in enumerate(states)] for e in names] + [list(range(len(states)))])
    counts = np.array([[int(s in events[e][0]) for s in states] for e in names] + [[0] * len(states)])

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [f for f in frames if len(f)]
        if not rows:
            return
        own = pd.concat(rows)
        own["place"] = pd.factorize(own[key], use_na_sentinel=False)[0]
        own = own.sort_values(["place", "at", "event_id"])
        event = pd.Index(names).get_indexer(own["event"])
        to, n = _composed(own["place"].to_numpy(), leads[event], counts[event])
        first = own.drop_duplicates("place")
        yield pd.DataFrame({key: first[key], "at": first["at"], "event_id": first["event_id"], "leads": list(to), "counts": list(n)})

    def step(key_: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, applied = state.get if state.exists else (initial, 0)
        chunks = list(frames)
        chunks = chunks[0] if len(chunks) == 1 else pd.concat(chunks)
        if len(chunks) > 1:
            chunks = chunks.sort_values(["at", "event_id"])
        i = states.index(status)
        for to, n in zip(chunks["leads"], chunks["counts"]):
            i, applied = int(to[i]), applied + int(n[i])
        state.update((states[i], applied))
        yield pd.DataFrame({key: [key_[0]], "status": [states[i]], "applied": [applied]})

    types = dict(log.dtypes)
    ranged = log.select(key, "at", "event_id", "event").repartitionByRange(key, "at", "event_id")
    chunks = ranged.mapInPandas(fold, f"{key} {types[key]}, at {types['at']}, event_id {types['event_id']}, leads array<int>, counts array<long>")
    return chunks.groupBy(key).applyInPandasWithState(step, f"{key} long, status string, applied long", "status string, applied long", "update", "NoTimeout")
