"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse scoring."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fraction_for, in_fraction
from .langid import crc_mod

#: Words: runs of letters and digits, runs of other marks.
WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+")
CACHED = 200_000
#: Fixed odd multipliers of the hashes.
PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass(frozen=True)
class Settings:
    """bits: hashed features are 2**bits, besides a bias. train_docs: expected number of training documents, taken by a
    hash of doc_id. shards: parts of the sample that are trained apart, whose weights are averaged. The rest is of FTRL."""

    bits: int = 18
    train_docs: int = 12_000
    shards: int = 4
    epochs: int = 4
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.01


def shape(word: str) -> int:
    """A word's shape, 2 to 15: capitals, title, lower case, number, mixed, or a mark by its kind."""
    if word.isupper():
        return 2 if len(word) > 1 else 3
    if word[0].isalpha():
        return 4 if word.islower() else 5 if word.istitle() else 6
    return 7 if word[0].isdigit() else 8 + 2 * ("!#$%&*|".find(word[0]) >= 0) + (len(word) > 1)


class Hasher:
    """Feature numbers and values of a text's n-grams; remembers word hashes.

    The n-grams are words and word pairs, and pairs and triples of shapes, where a word equal to the one before has a
    shape of its own. Each of the two kinds has its dampened counts brought to length one.
    """

    def __init__(self, bits: int):
        self.mask, self.known = (1 << bits) - 1, {}

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = WORD.findall(text)
        if len(self.known) > CACHED:
            self.known = {}
        for w in set(words).difference(self.known):
            self.known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) << 4 | shape(w)
        both = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        h, shapes = both >> np.uint64(4), both & np.uint64(15)
        shapes[1:][h[1:] == h[:-1]] = 1
        pairs = h[:-1] * PRIMES[0] + h[1:] * PRIMES[1]
        two = shapes[:-1] << np.uint64(4) | shapes[1:]
        three = two[:-1] << np.uint64(4) | shapes[2:] | np.uint64(1 << 16)
        found = []
        for grams in (np.concatenate([h * PRIMES[2], pairs]), np.concatenate([two, three]) * PRIMES[3]):
            at, n = np.unique(grams >> np.uint64(20) & np.uint64(self.mask), return_counts=True)
            x = np.log1p(n)
            found.append((at.astype(np.int64), x / max(1e-9, np.sqrt((x * x).sum()))))
        (a, x), (b, y) = found
        at, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        return at, np.bincount(place, np.concatenate([x, y]), len(at))


def fit(texts: list[str], labels: list[int], s: Settings, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) after FTRL-proximal updates, one document at a time."""
    hasher, n = Hasher(s.bits), (1 << s.bits) + 1
    z, g2 = np.zeros(n), np.zeros(n)
    rows = [hasher.features(t) for t in texts]
    rows = [(np.append(at, n - 1), np.append(x, 1.0)) for at, x in rows]

    def weights(at=slice(None)) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= s.l1, 0, -(zz - np.sign(zz) * s.l1) / ((s.beta + np.sqrt(g2[at])) / s.alpha + s.l2))

    for epoch in range(s.epochs):
        for i in np.random.default_rng(seed + epoch).permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - labels[i]) * x
            z[at] += g - (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / s.alpha * w
            g2[at] += g * g
    return weights()


def _fit_shard(s: Settings):
    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        w = fit(pdf["text"].tolist(), pdf["label"].tolist(), s)
        at = np.flatnonzero(w)
        return pd.DataFrame({"feature": [*at, -1], "weight": [*w[at], 1.0]})

    return rows


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Weights from `docs` (doc_id, text) joined with `labels` (doc_id, label 0 or 1): the mean of the shards that have rows.

    Trains on a hash sample of about settings.train_docs documents in settings.shards tasks; only hashed weights,
    at most 2**bits + 1, pass through the driver. Rows with a null id, text or label are not learned from.
    """
    labels = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    share = fraction_for(settings.train_docs, labels.count())
    known = labels.filter(in_fraction(F.col("doc_id"), share))
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text").filter(in_fraction(F.col("doc_id"), share))
    sample = texts.join(known, "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(settings.shards)))
    trained = sample.groupBy("shard").applyInPandas(_fit_shard(settings), "feature long, weight double")
    got = trained.groupBy("feature").agg(F.sum("weight").alias("weight")).toPandas()
    sums = np.zeros((1 << settings.bits) + 2)  # the last, feature -1, counts the shards
    sums[got["feature"].to_numpy(int)] = got["weight"].to_numpy(float)
    return sums[:-1] / max(1.0, sums[-1])


@lru_cache(1)
def _hasher(bits: int) -> Hasher:
    return Hasher(bits)


def probability(spark: SparkSession, weights: np.ndarray, text: str = "text") -> Column:
    """The score of each row's whole text, a sparse dot product; a column, so only texts go to Python.

    Defined cases: null and empty texts get the score of the bias alone.
    """
    sent, bits = spark.sparkContext.broadcast(weights.astype(np.float32)), (len(weights) - 1).bit_length() - 1

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, h = sent.value, _hasher(bits)
        for texts in batches:
            found = map(h.features, texts.fillna(""))
            yield pd.Series([1 / (1 + np.exp(-np.clip(w[at] @ x + w[-1], -30, 30))) for at, x in found], dtype="float64")

    return F.pandas_udf(score, "double")(F.col(text))


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (1 from the threshold on) for each row's whole text; see probability.

    Rows are independent, so null and repeated ids need no rule; other columns are ignored; an empty table gives no row.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), probability(docs.sparkSession, weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.filter(crc_mod("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, train(docs, quality_labels(spark, sf_dir)))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
