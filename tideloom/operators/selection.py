"""Load-balance picks of a server for each request."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import java_hash

#: Fixed values of the ring: digests to a server, slots to a digest.
DIGESTS, SLOTS = 16, 4


def first_by(candidates: DataFrame, group: str, *order: Column) -> DataFrame:
    """The first candidate of each group in an order."""
    return candidates.withColumn("__place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter("__place = 1").drop("__place")


def random_pick(candidates: DataFrame, group: str, seed: int = 0) -> DataFrame:
    return first_by(candidates, group, F.rand(seed))


def least_frequent(candidates: DataFrame, group: str, id: str) -> DataFrame:
    """Fewest accesses (see access_statistics), then smallest id."""
    return first_by(candidates, group, F.asc("accesses"), F.asc(id))


def least_recent(candidates: DataFrame, group: str, id: str) -> DataFrame:
    """Oldest last access, those without any first, then smallest id."""
    return first_by(candidates, group, F.asc_nulls_first("last_at"), F.asc(id))


def appoint(candidates: DataFrame, group: str, id: str, wanted: str) -> DataFrame:
    """The candidate of a wanted id or host:port."""
    address = F.concat_ws(":", "host", F.col("port").cast("string"))
    return first_by(candidates.filter((F.col(id).cast("string") == wanted) | (address == wanted)), group, F.asc(id))


def round_robin(requests: DataFrame, servers: DataFrame, group: str, id: str, number: str) -> DataFrame:
    """Request `number` (from 0) of a group goes to server number mod n, in order of id. Servers are numbered, so a request
    carries its place and a group's requests are spread over its servers."""
    ring = servers.select(group, id).filter(F.col(id).isNotNull()).distinct()
    ring = ring.withColumn("__place", F.row_number().over(Window.partitionBy(group).orderBy(id)).cast("long") - 1)
    length = ring.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    placed = requests.join(length, group).withColumn("__place", F.col(number).cast("long") % F.col("__n")).drop("__n")
    return placed.join(ring, [group, "__place"], "left").drop("__place")


def smooth_cycle(weights: list[int]) -> list[int]:
    """One cycle of smooth weighted round robin over servers of these weights; it repeats after their sum over their divisor.

    Servers of one weight are picked in turn, so a step compares one candidate for each distinct weight, not all servers.
    """
    by: dict[int, list[int]] = {}
    divisor, out = math.gcd(*weights), []
    for i, w in enumerate(weights):
        by.setdefault(w // divisor, []).append(i)
    total, turn = sum(w * len(own) for w, own in by.items()), dict.fromkeys(by, 0)
    for t in range(1, total + 1):
        best, most = 0, None
        for w, own in by.items():
            rounds, at = divmod(turn[w], len(own))
            value = (t * w - total * rounds, -own[at])
            if most is None or value > most:
                best, most = w, value
        out.append(-most[1])
        turn[best] += 1
    return out


def _cycles(group: str, id: str, weight: str):
    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id)
        order = smooth_cycle(pdf[weight].astype(int).tolist())
        return pd.DataFrame({group: pdf[group].iloc[0], "__step": range(len(order)), id: pdf[id].to_numpy()[order], "__n": len(order)})

    return rows


def weighted_round_robin(requests: DataFrame, servers: DataFrame, group: str, id: str, weight: str, number: str) -> DataFrame:
    """Smooth weighted round robin. Its cycle is worked out once for each group; requests then only look up their step."""
    types = {n: t for n, t in servers.dtypes}
    schema = f"{group} {types[group]}, __step long, {id} {types[id]}, __n long"
    cycles = servers.select(group, id, weight).filter(F.col(weight) > 0).groupBy(group).applyInPandas(_cycles(group, id, weight), schema)
    length = cycles.groupBy(group).agg(F.max("__n").alias("__n"))
    stepped = requests.join(length, group).withColumn("__step", F.col(number) % F.col("__n")).drop("__n")
    return stepped.join(cycles.drop("__n"), [group, "__step"]).drop("__step")


def ring_slots(servers: DataFrame, group: str, id: str) -> DataFrame:
    """64 slots of each server: four little-endian 32-bit parts of the MD5 of id and number. An equal slot is the largest id's."""
    numbered = servers.select(group, id, F.explode(F.sequence(F.lit(0), F.lit(DIGESTS - 1))).alias("i"))
    digest = numbered.withColumn("d", F.md5(F.concat(F.col(id).cast("string"), F.col("i").cast("string")).cast("binary")))
    parts = [F.conv(F.concat(*(F.substring("d", 8 * j + 7 - 2 * b, 2) for b in range(4))), 16, 10).cast("long") for j in range(SLOTS)]
    return digest.select(group, id, F.explode(F.array(*parts)).alias("slot")).groupBy(group, "slot").agg(F.max(id).alias(id))


def consistent_hash(requests: DataFrame, servers: DataFrame, group: str, id: str, key: str) -> DataFrame:
    """The server at the first slot at or after the request key's hash, else at the first slot of all.

    A slot serves an interval of hashes. Intervals are cut at multiples of 2^24, so requests find theirs by an equi-join
    on group and leading byte and one comparison, however large a group is.
    """
    w = Window.partitionBy(group).orderBy("slot")
    slots = ring_slots(servers, group, id)
    spans = slots.select(group, id, F.coalesce(F.lag("slot").over(w) + 1, F.lit(0)).alias("lo"), F.col("slot").alias("hi"))
    lowest = slots.groupBy(group).agg(F.min_by(id, "slot").alias(id), (F.max("slot") + 1).alias("lo"))
    spans = spans.unionByName(lowest.select(group, id, "lo", F.lit((1 << 32) - 1).cast("long").alias("hi"))).filter("lo <= hi")
    spans = spans.withColumn("top", F.explode(F.sequence(F.shiftright("lo", 24), F.shiftright("hi", 24))))
    # The key's signed hash is read as unsigned, as slots are.
    hashed = requests.withColumn("h", F.pmod(java_hash(F.col(key).cast("string")), F.lit(1 << 32))).withColumn("top", F.shiftright("h", 24))
    return hashed.join(spans, [group, "top"]).filter(F.col("h").between(F.col("lo"), F.col("hi"))).drop("top", "lo", "hi")


def failover(candidates: DataFrame, group: str, failed: DataFrame, id: str, most: int = 3) -> DataFrame:
    """Up to `most` candidates of each group to try in turn, without those that failed."""
    left = candidates.join(failed.select(group, id), [group, id], "left_anti")
    return left.withColumn("attempt", F.row_number().over(Window.partitionBy(group).orderBy(id))).filter(F.col("attempt") <= most)


