"""Connected components by alternating star steps on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_split_join, materialize


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """From pairs (a, b): links neighbours of each a, and a itself, to the least of them. Hot nodes are broadcast, not grouped."""
    pairs = materialize(pairs, "star_pairs")
    least = pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    least = materialize(least, "star_least")
    total = least.agg(F.sum("n")).first()[0] or 0
    near = hot_split_join(pairs, least, ["a"], "n", total)
    found = near.filter("b > a").select(F.col("b").alias("hi"), F.col("m").alias("lo"))
    if not larger_only:
        found = near.select(F.col("b").alias("hi"), F.col("m").alias("lo")).unionByName(least.select(F.col("a").alias("hi"), F.col("m").alias("lo")))
    return found.filter("hi <> lo").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable) for all nodes of edges (hi, lo), hi > lo.

    Alternates large stars (a node's larger neighbours link to its least) and small stars (its smaller ones do), each
    round written to the shared folder, until nothing changes: logarithmically many rounds, no collection of a component.
    """
    e = materialize(edges.filter("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        both = e.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionByName(e.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        large = _star(both, True)
        e = materialize(_star(large.select(F.col("hi").alias("a"), F.col("lo").alias("b")), False), "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if now == mark:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
