"""Workflow graphs: nodes (dag_id, node_id, node_type, status, skip_when_fail) and edges (dag_id, source, target)."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import first_error

#: Fixed value: nodes that a workflow may have.
MOST_NODES = 100


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges whose ends both exist."""
    ids = nodes.select("dag_id", "node_id").filter("node_id IS NOT NULL").distinct()
    kept = edges.join(ids.withColumnRenamed("node_id", "source"), ["dag_id", "source"], "left_semi")
    return kept.join(ids.withColumnRenamed("node_id", "target"), ["dag_id", "target"], "left_semi").select("dag_id", "source", "target").distinct()


def origins(edges: DataFrame) -> DataFrame:
    """Nodes with edges out and none in."""
    return edges.select("dag_id", F.col("source").alias("node_id")).distinct().join(edges.select("dag_id", F.col("target").alias("node_id")), ["dag_id", "node_id"], "left_anti")


def lasts(edges: DataFrame) -> DataFrame:
    """Nodes with edges in and none out."""
    return edges.select("dag_id", F.col("target").alias("node_id")).distinct().join(edges.select("dag_id", F.col("source").alias("node_id")), ["dag_id", "node_id"], "left_anti")


def neighbours(edges: DataFrame) -> DataFrame:
    """Sorted predecessors and successors of each node that has any."""
    out = edges.groupBy("dag_id", F.col("source").alias("node_id")).agg(F.array_sort(F.collect_set("target")).alias("successors"))
    into = edges.groupBy("dag_id", F.col("target").alias("node_id")).agg(F.array_sort(F.collect_set("source")).alias("predecessors"))
    return out.join(into, ["dag_id", "node_id"], "full")


def effective_status() -> Column:
    """A failure that may be skipped counts as success."""
    return F.when((F.col("status") == "failed") & F.col("skip_when_fail"), F.lit("succeed")).otherwise(F.col("status"))


def ready(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, not begun, that may start: with predecessors, of which all succeeded or may be skipped."""
    done = nodes.select("dag_id", F.col("node_id").alias("source"), (effective_status() == "succeed").alias("ok"))
    counts = edges.join(done, ["dag_id", "source"], "left").groupBy("dag_id", F.col("target").alias("node_id"))
    met = counts.agg(F.count(F.lit(1)).alias("needs"), F.count_if(F.coalesce("ok", F.lit(False))).alias("met")).filter("met >= needs")
    return nodes.filter("status = 'inited'").select("dag_id", "node_id").join(met, ["dag_id", "node_id"])


def is_cyclic(edges: Iterable[tuple]) -> bool:
    """Takes away nodes without an edge in until none is left, or a cycle is."""
    out: dict = {}
    into: dict = {}
    for a, b in set(edges):
        out.setdefault(a, []).append(b)
        into[b] = into.get(b, 0) + 1
        into.setdefault(a, 0)
    free, left = [n for n, k in into.items() if not k], len(into)
    while free:
        left -= 1
        for b in out.get(free.pop(), ()):
            into[b] -= 1
            if not into[b]:
                free.append(b)
    return left > 0


def _may_be_cyclic() -> Column:
    """Whether an edge of `e` doesn't lead to a greater id, as one of each cycle's does."""
    return F.exists("e", lambda x: x["source"] >= x["target"])


def _cyclic() -> Column:
    """Whether the edges `e` of a row have a cycle; where they are null, false. Many rows go to Python in one batch."""

    def cyclic(sources: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([a is not None and is_cyclic(zip(a.tolist(), b.tolist())) for a, b in zip(sources, targets)], dtype="bool")

    return F.pandas_udf(cyclic, "boolean")(F.transform("e", lambda x: x["source"]), F.transform("e", lambda x: x["target"]))


def cycles(edges: DataFrame) -> DataFrame:
    """dag_id and whether the graph has a cycle, reachable from an origin or not.

    A graph is a row; its test is linear, and only graphs with an edge that doesn't lead to a greater id are sent to it.
    """
    graphs = edges.groupBy("dag_id").agg(F.collect_set(F.struct("source", "target")).alias("e"))
    return graphs.select("dag_id", F.when(_may_be_cyclic(), F.col("e")).alias("e")).select("dag_id", _cyclic().alias("cyclic"))


def _graphs(nodes: DataFrame, edges: DataFrame, most_nodes: int) -> DataFrame:
    """A row for each graph: n nodes, counted to most_nodes + 1 (null without nodes), bad ones, and of graphs of no more than
    most_nodes: nodes, valid edges as e, and the nodes that are origins and lasts.

    Nodes and edges are brought together by dag_id alone. A graph that has more nodes is invalid whatever its edges, so no row
    holds more than most_nodes + 1 nodes and their most_nodes squared edges; other edges are left out before they are gathered.
    """
    place = F.row_number().over(Window.partitionBy("dag_id").orderBy("node_id"))
    unknown = ~F.coalesce(F.col("node_type").isin("start", "executor", "end"), F.lit(False))
    own = nodes.select("dag_id", "node_id", "node_type", place.alias("place")).filter(F.col("place") <= most_nodes + 1).groupBy("dag_id")
    own = own.agg(F.count(F.lit(1)).alias("n"), F.count_if(unknown).alias("bad"), F.collect_list(F.struct("node_id", "node_type")).alias("nodes"))
    own = own.select("dag_id", F.struct("n", "bad", F.when(F.col("n") <= most_nodes, F.col("nodes")).alias("nodes")).alias("own"))
    has = lambda end: F.exists("own.nodes", lambda x: x["node_id"] == F.col(end))
    both = edges.select("dag_id", "source", "target").join(own, "dag_id", "full")
    graphs = both.groupBy("dag_id").agg(F.first("own", True).alias("own"), F.collect_set(F.when(has("source") & has("target"), F.struct("source", "target"))).alias("e"))
    ends = lambda name: F.transform("e", lambda x: x[name])
    origin, last = F.array_except(ends("source"), ends("target")), F.array_except(ends("target"), ends("source"))
    return graphs.select("dag_id", "own.*", "e", origin.alias("origins"), last.alias("lasts"))


def _not_of_type(ends: str, kind: str) -> Column:
    """Whether some of a graph's nodes among `ends` have another type."""
    return F.coalesce(F.exists("nodes", lambda x: F.array_contains(ends, x["node_id"]) & (x["node_type"] != kind)), F.lit(False))


def _with_cycles(graphs: DataFrame) -> DataFrame:
    """dag_id and error, which is `cyclic` where there is no other and a cycle."""
    some = graphs.select("dag_id", "error", F.when(F.col("error").isNull() & _may_be_cyclic(), F.col("e")).alias("e"))
    return some.select("dag_id", F.coalesce("error", F.when(_cyclic(), "cyclic")).alias("error"))


def validate(nodes: DataFrame, edges: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """dag_id and the first error: too_many_nodes, no_origin, origin_type, no_last, cyclic; null if there is none."""
    error = first_error((F.col("n") > most_nodes, "too_many_nodes"), (F.size("origins") == 0, "no_origin"), (_not_of_type("origins", "start"), "origin_type"), (F.size("lasts") == 0, "no_last"))
    return _with_cycles(_graphs(nodes, edges, most_nodes).filter("n IS NOT NULL").withColumn("error", error))


def validate_workflow(nodes: DataFrame, edges: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """dag_id and the first error of all stages: empty, too_many_nodes, node_error, no_origin, origin_type, no_last, last_type, cyclic.

    A graph that has edges but no nodes is empty. A node's error is a type that is none of start, executor and end; its
    executor's own settings are not columns of nodes.
    """
    error = first_error(
        (F.col("n").isNull(), "empty"), (F.col("n") > most_nodes, "too_many_nodes"), (F.col("bad") > 0, "node_error"), (F.size("origins") == 0, "no_origin"), (_not_of_type("origins", "start"), "origin_type"),
        (F.size("lasts") == 0, "no_last"), (_not_of_type("lasts", "end"), "last_type"),
    )
    return _with_cycles(_graphs(nodes, edges, most_nodes).withColumn("error", error))


def finished(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Graphs whose nodes without successors have all succeeded."""
    ends = nodes.join(edges.select("dag_id", F.col("source").alias("node_id")), ["dag_id", "node_id"], "left_anti")
    return ends.groupBy("dag_id").agg(F.bool_and(effective_status() == "succeed").alias("succeeded"))


def jobs_of(nodes: DataFrame) -> DataFrame:
    """The job type that runs each node; start and end need no worker."""
    kind = F.when(F.col("node_type").isin("start", "end"), "input_output").when(F.col("node_type") == "executor", "executor").otherwise("unknown")
    return nodes.select("dag_id", "node_id", kind.alias("job_type"), F.col("node_type").isin("start", "end").alias("at_once"))
