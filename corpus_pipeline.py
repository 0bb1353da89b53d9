"""A corpus pipeline of five training-data operators: each stage's table is written and is the next one's documents.

Every stage but the last returns the columns of documents. The two classifiers filter rows where they lie; the two dedup
stages keep rows by doc_id, so of rows that share one all stay if any does. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideloom.llm.common import HOT_SHARE, materialize
from tideloom.llm.exact_dedup import dedup_all
from tideloom.llm.langid import crc_mod
from tideloom.llm.langid import prediction as language_of
from tideloom.llm.langid import train as train_language
from tideloom.llm.packing import pack_documents
from tideloom.llm.quality import probability, quality_labels
from tideloom.llm.quality import train as train_quality
from tideloom.llm.simhash import near_duplicates
from tideloom.session import ship

#: A language must have this posterior; all texts with enough letters to tell have one near 1.
LEAST_SCORE = 0.5
#: A document scored below is poor.
GOOD = 0.3


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is in ids (doc_id), nulls alike. Ids of very many rows, null among them, are broadcast with
    what becomes of them, so that their rows stay where they are."""
    few = ids.select(F.col("doc_id").alias("__id"), F.lit(True).alias("__stays")).distinct()
    counts = docs.groupBy(F.col("doc_id").alias("__own")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    hot = counts.filter(F.col("n") * HOT_SHARE >= docs.count())
    hot = materialize(hot.join(few, hot["__own"].eqNullSafe(few["__id"]), "left").select("__own", F.coalesce("__stays", F.lit(False)).alias("__stays")), "hot_ids")
    often = docs.join(F.broadcast(hot.filter("__stays")), docs["doc_id"].eqNullSafe(hot["__own"]), "left_semi")
    rest = docs.join(F.broadcast(hot), docs["doc_id"].eqNullSafe(hot["__own"]), "left_anti")
    return often.unionByName(rest.join(few, rest["doc_id"].eqNullSafe(few["__id"]), "left_semi"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language that the model knows."""
    ship(spark)
    langs, probs = train_language(docs.filter(crc_mod("doc_id", 4) != 2))
    p = language_of(spark, langs, probs)
    return docs.filter((p["lang_pred"] != "und") & (p["score"] >= LEAST_SCORE))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier finds poor."""
    ship(spark)
    return docs.filter(probability(spark, train_quality(docs, quality_labels(spark, sf_dir))) >= GOOD)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each text."""
    ship(spark)
    return _keep(docs, dedup_all(docs).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each near-duplicate component."""
    ship(spark)
    return _keep(docs, near_duplicates(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left."""
    ship(spark)
    return pack_documents(docs)


STAGES = [("language", language), ("quality", quality), ("exact", exact), ("near", near), ("packing", packing)]

#: SQL cannot express the models and the tokenizer; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
