"""SimHash near-dedup by the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_left_join, hot_split_join, materialize
from .components import connected_components

BITS = 64
#: Bits of each partition that candidate counts are estimated on.
ESTIMATE_BITS = 12
#: Partitions that plans are made for.
SCHEMES = (2, 3, 4)
#: Rows of a key that make a block; larger keys are cut.
BLOCK = 2048
#: Time to write and sort a probe against that to compare two fingerprints.
PROBE_COST = 50.0


def fingerprints_of(texts: list[str], width: int = 3, chunk: int = 200_000) -> np.ndarray:
    """64-bit SimHash of each whole text, as unsigned integers; shingles hashed by XXH64 with seed 42, repeats included."""
    from xxhash import xxh64_intdigest

    out, pending, spans, held = np.zeros(len(texts), np.uint64), [], [], 0

    def flush() -> None:
        nonlocal pending, spans, held
        h = np.fromiter((xxh64_intdigest(s, 42) for p in pending for s in p), np.uint64, held)
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = 0
        for i, n in spans:
            ones_of = ones[at : at + n].sum(0, dtype=np.int64)
            out[i] = np.packbits(ones_of * 2 > n, bitorder="little").view(np.uint64)[0]
            at += n
        pending, spans, held = [], [], 0

    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        n = max(1, len(words) - width + 1)
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) > width else [b" ".join(words)]
        if n > 4 * chunk:  # a very long text: counted in parts
            ones_of = np.zeros(BITS, np.int64)
            it = iter(shingles)
            while len(h := np.fromiter((xxh64_intdigest(s, 42) for _, s in zip(range(chunk), it)), np.uint64)):
                ones_of += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[i] = np.packbits(ones_of * 2 > n, bitorder="little").view(np.uint64)[0]
            continue
        pending.append(shingles), spans.append((i, n))
        held += n
        if held >= chunk:
            flush()
    if held:
        flush()
    return out


def _fingerprint(width: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(fp=fingerprints_of(b["text"].fillna("").tolist(), width).view(np.int64))

    return rows


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (as a signed long) of each row of `docs`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(_fingerprint(width), "doc_id long, fp long")


@dataclass(frozen=True)
class Plan:
    """Partitions of the bits and their thresholds: of any two fingerprints within `distance`, some partition differs in
    no more bits than its threshold. -1: the partition is not looked at."""

    partitions: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    distance: int


def group_bits(both: np.ndarray, n: int, parts: int) -> list[tuple[int, ...]]:
    """Bits in `parts` partitions of near-equal width, correlated ones together. both[i, j]: rows that have bits i and j.

    Each partition starts with the free bit of the strongest correlations and takes the free bit most correlated with it.
    """
    p = np.diag(both) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        own = [max(sorted(free), key=lambda i: r[i, sorted(free)].sum())]
        free.remove(own[0])
        while len(own) < size:
            own.append(max(sorted(free), key=lambda i: r[i, own].sum()))
            free.remove(own[-1])
        out.append(tuple(sorted(own)))
    return out


def values(fp: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The partition's bits of each fingerprint, put together."""
    v = np.zeros(len(fp), np.uint64)
    for k, bit in enumerate(bits):
        v |= (fp >> np.uint64(bit) & np.uint64(1)) << np.uint64(k)
    return v


def masks(width: int, most: int) -> np.ndarray:
    """All values with at most `most` of `width` bits set; none for a threshold of -1."""
    return np.array([sum(1 << b for b in c) for d in range(most + 1) for c in combinations(range(width), d)], np.uint64)


def candidates(h: np.ndarray, width: int, threshold: int) -> float:
    """Estimated pairs within the threshold on a partition, from a histogram of its first bits, the rest taken as even."""
    if threshold < 0:
        return 0.0
    seen = min(width, ESTIMATE_BITS)
    rest, h, total = width - seen, h.astype(float), 0.0
    for d in range(threshold + 1):
        own = sum(float(h @ h[np.arange(len(h)) ^ m]) for m in (sum(1 << b for b in c) for c in combinations(range(seen), d)))
        total += own * sum(comb(rest, j) for j in range(min(rest, threshold - d) + 1)) / 2**rest
    return max(0.0, total - h.sum()) / 2


def allocate(costs: list[list[float]], distance: int) -> tuple[float, tuple[int, ...]]:
    """Least total cost of thresholds that sum to distance - parts + 1, by dynamic programming. costs[i][t + 1]: of threshold t."""
    parts = len(costs)
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for own in costs:
        new: dict[int, tuple[float, tuple[int, ...]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                x = (cost + own[t + 1], (*chosen, t))
                if spent + t + 1 <= distance + 1 and (spent + t + 1 not in new or x < new[spent + t + 1]):
                    new[spent + t + 1] = x
        best = new
    assert all(sum(t + 1 for t in c) == s for s, (_, c) in best.items()) and parts
    return best[distance + 1]


def _bit_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    both = np.zeros((BITS, BITS))
    for b in batches:
        ones = np.unpackbits(b["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        both += ones.T @ ones
    yield pd.DataFrame({"i": range(BITS), "both": both.tolist()})


def _histograms(schemes: list[list[tuple[int, ...]]]):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = np.zeros((sum(map(len, schemes)), 1 << ESTIMATE_BITS), np.int64)
        for b in batches:
            fp = b["fp"].to_numpy(np.int64).view(np.uint64)
            for k, bits in enumerate(x for s in schemes for x in s):
                h[k] += np.bincount(values(fp, bits[:ESTIMATE_BITS]).astype(np.int64), minlength=h.shape[1])
        k, v = np.nonzero(h)
        yield pd.DataFrame({"k": k, "v": v, "n": h[k, v]})

    return rows


def make_plan(nodes: DataFrame, distance: int) -> Plan:
    """Partitions and thresholds of least estimated cost, from statistics of all distinct fingerprints `nodes` (fp).

    The driver gets 64 x 64 sums and a histogram of 2**ESTIMATE_BITS counts for each partition, whatever the input.
    """
    got = nodes.select("fp").mapInPandas(_bit_counts, "i int, both array<double>")
    sums = [F.sum(F.col("both")[j]).alias(str(j)) for j in range(BITS)]
    table = got.groupBy("i").agg(*sums).toPandas().set_index("i").reindex(range(BITS)).fillna(0)
    n = nodes.count()
    schemes = [group_bits(table.to_numpy(float), n, parts) for parts in SCHEMES if parts <= distance + 1]
    counts = nodes.select("fp").mapInPandas(_histograms(schemes), "k int, v int, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).toPandas()
    h = np.zeros((sum(map(len, schemes)), 1 << ESTIMATE_BITS))
    h[counts["k"].to_numpy(int), counts["v"].to_numpy(int)] = counts["n"].to_numpy(float)
    plans, k = [], 0
    for bits in schemes:
        costs = []
        for own in bits:
            probes = [0 if t < 0 else sum(comb(len(own), d) for d in range(t + 1)) for t in range(-1, distance + 1)]
            seen = h[k].reshape(-1)[: 1 << min(ESTIMATE_BITS, len(own))]
            costs.append([n * p * PROBE_COST + candidates(seen, len(own), t - 1) for t, p in enumerate(probes)])
            k += 1
        cost, thresholds = allocate(costs, distance)
        plans.append((cost, Plan(tuple(bits), thresholds, distance)))
    return min(plans, key=lambda x: x[0])[1]


def _signatures(plan: Plan):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [(i, bits, masks(len(bits), t)) for i, (bits, t) in enumerate(zip(plan.partitions, plan.thresholds)) if t >= 0]
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for i, bits, flips in every:
                v = values(fp.view(np.uint64), bits)
                for lo in range(0, len(flips), 64):
                    keys = (v[:, None] ^ flips[None, lo : lo + 64]).ravel().view(np.int64)
                    yield pd.DataFrame({"part": np.int32(i), "key": keys, "fp": np.repeat(fp, len(flips[lo : lo + 64]))})

    return rows


def _least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n nodes over edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def forest(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (larger, smaller) that join the linked fingerprints of each group like all links within `distance` do.

    Rows come sorted by group and fingerprint. Compares each row with those behind it in its group, step by step, and
    keeps for each set of linked rows only edges to its least one.
    """
    label = np.arange(len(fp))
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)) if len(group) else np.zeros(0, np.int64)
    end = np.repeat(ends, np.diff(ends, prepend=0))
    at, step, a, b, held = np.arange(len(fp)), 1, [], [], 0
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        hit = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
        if len(hit):
            a.append(hit), b.append(hit + step)
            held += len(hit)
            if held > 2_000_000:
                label = _least_labels(len(fp), *(np.concatenate(x) for x in ([np.arange(len(fp)), *a], [label, *b])))
                a, b, held = [], [], 0
        step += 1
    label = _least_labels(len(fp), *(np.concatenate(x) for x in ([np.arange(len(fp)), *a], [label, *b])))
    own = np.flatnonzero((label != np.arange(len(fp))) & (fp != fp[label]))
    return fp[own], fp[label[own]]


def _links(distance: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, held = ["part", "key", "one", "two"], None

        def linked(b: pd.DataFrame) -> pd.DataFrame:
            keys = b[columns].to_numpy(np.int64)
            new = np.append(True, (keys[1:] != keys[:-1]).any(1)) if len(b) else np.zeros(0, bool)
            x, y = forest(np.cumsum(new), b["fp"].to_numpy(np.int64).view(np.uint64), distance)
            x, y = x.view(np.int64), y.view(np.int64)
            return pd.DataFrame({"hi": np.maximum(x, y), "lo": np.minimum(x, y)}).drop_duplicates()

        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            last = (b[columns] == b[columns].iloc[-1]).all(axis=1).to_numpy()
            cut = int(np.argmax(last))  # the last group may go on in the next batch
            held = b.iloc[cut:]
            if cut:
                yield linked(b.iloc[:cut])
        if held is not None and len(held):
            yield linked(held)

    return rows


def links(nodes: DataFrame, plan: Plan) -> DataFrame:
    """Edges (hi, lo) between distinct fingerprints that connect whatever links within plan.distance connect.

    Fingerprints meet under the keys that the plan gives them. A key with more than BLOCK rows is cut into blocks of about
    that size, each pair of which is a unit of work: however large the input or a key, a unit has about 2 * BLOCK rows.
    No pair is skipped, none is written out.
    """
    keys = materialize(nodes.select("fp").mapInPandas(_signatures(plan), "part int, key long, fp long"), "signatures")
    sizes = keys.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    sizes = materialize(sizes.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "signature_sizes")
    # Keys that are cut are as many as the input makes them: only very common ones are broadcast, the others joined.
    cut = hot_left_join(keys, sizes, ["part", "key"], "n", keys.count()) if not sizes.isEmpty() else keys.withColumn("blocks", F.lit(1))
    block = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    units = cut.select("part", "key", "fp", block.alias("block"), other.alias("other"))
    units = units.select("part", "key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "fp")
    units = units.repartition("part", "key", "one", "two").sortWithinPartitions("part", "key", "one", "two", "fp")
    return units.mapInPandas(_links(plan.distance), "hi long, lo long")


def near_duplicates(docs: DataFrame, distance: int = 3, width: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of `docs` (doc_id, text).

    Equal fingerprints become one node; nodes are linked, and a component's id is the least doc_id of all its rows.

    Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; rows that repeat a
    doc_id are rows of their own; null doc_ids never name a component unless all of it are null; an empty table gives no
    row; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, width), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    found = links(nodes, make_plan(nodes, distance))
    roots = connected_components(found).withColumnRenamed("node", "fp")
    labelled = materialize(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "labelled")
    classes = labelled.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("nodes"))
    total = nodes.count()
    named = materialize(hot_split_join(labelled, classes, ["root"], "nodes", total).select("fp", "component_id", "n"), "named")
    rows = prints.count()
    out = hot_split_join(prints, named, ["fp"], "n", rows)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
