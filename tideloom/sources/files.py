"""Readers and writers: parquet and JDBC, create or replace, append, upsert, replace by key."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.joins import replace_by_key
from ..operators.joins import upsert as upserted


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1, **options: str) -> DataFrame:
    """A database table; with a numeric key, read in parallel ranges. The driver's jar must be on the class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions))
    return reader.load()


def exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def create_or_replace(df: DataFrame, table: str) -> DataFrame:
    df.write.mode("overwrite").saveAsTable(table)
    return df.sparkSession.table(table)


def append(df: DataFrame, table: str) -> None:
    df.write.mode("append").saveAsTable(table)


def _swap(spark: SparkSession, table: str, df: DataFrame) -> DataFrame:
    """Writes beside the table that df reads, then takes its name."""
    new = f"{table}_{uuid.uuid4().hex[:8]}"
    df.write.saveAsTable(new)
    spark.sql(f"DROP TABLE {table}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {table}")
    return spark.table(table)


def upsert(df: DataFrame, table: str, key: list[str], version: str) -> DataFrame:
    """The table with the latest row of each key by version."""
    spark = df.sparkSession
    return _swap(spark, table, upserted(spark.table(table), df, key, version))


def replace(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """The table with all rows of df's keys replaced."""
    spark = df.sparkSession
    return _swap(spark, table, replace_by_key(spark.table(table), df, key))


def next_ids(spark: SparkSession, current: int, count: DataFrame, step: int = 100) -> DataFrame:
    """`count` rows with an `id` each: a block of ids for each partition, a multiple of step, without one task for all.

    Ids are unique and above `current`; as with segments handed to nodes, some are left over.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    numbered = count.withColumn("__part", F.spark_partition_id())
    sizes = [tuple(r) for r in numbered.groupBy("__part").count().orderBy("__part").collect()]
    starts, at = [], current
    for part, n in sizes:
        starts.append((part, at))
        at += -(-n // step) * step
    blocks = spark.createDataFrame(starts, "__part int, __start long")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(F.monotonically_increasing_id()))
    return numbered.withColumn("__place", place).join(F.broadcast(blocks), "__part").withColumn("id", F.col("__start") + F.col("__place")).drop("__part", "__place", "__start")
