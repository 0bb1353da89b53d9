"""Helpers shared by the training-data operators: the shared folder, written tables, skew-proof joins."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least 1/HOT_SHARE of all rows, so at most HOT_SHARE keys are ever broadcast.
HOT_SHARE = 4096


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only where that setting is unset on a single machine (tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tideloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tideloom/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def work_table(spark: SparkSession, name: str) -> str:
    """Full name of a new table whose files lie in the shared folder and go with it when it is dropped."""
    base = shared_dir(spark, "tables").rsplit("/", 1)[0]
    database = f"tideloom_{zlib.crc32(base.encode()):08x}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{base}/tables'")
    return f"{database}.{name}_{uuid.uuid4().hex[:12]}"


def table_path(spark: SparkSession, table: str) -> str:
    return spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Location'").first()["data_type"]


def write_sorted_buckets(df: DataFrame, table: str, keys: list[str], buckets: int, append: bool = False) -> None:
    """Create a table, or append to it, bucketed and sorted by `keys`: merge joins on the keys read it without a shuffle."""
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.mode("append" if append else "errorifexists").saveAsTable(table)


def hot_left_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Left join of many `rows` with one `groups` row per key, split as in hot_split_join; keys must not be null in `groups`."""
    is_hot = F.col(size) * F.lit(HOT_SHARE) >= F.lit(total)
    hot, cold = groups.filter(is_hot), groups.filter(~is_hot)
    few = rows.join(F.broadcast(hot), keys)
    many = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return few.unionByName(many.select(*few.columns))


def hot_split_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of many `rows` with one `groups` row per key, safe when one key holds a third of all rows.

    `size` is a column of `groups` with the number of rows of the key and `total` their sum. Keys with at least
    total/HOT_SHARE rows number at most HOT_SHARE and are broadcast; the rest cannot be skewed and is shuffled.
    `rows` is read twice, so it should be a written table.
    """
    is_hot = F.col(size) * F.lit(HOT_SHARE) >= F.lit(total)
    hot, cold = groups.filter(is_hot), groups.filter(~is_hot)
    few = rows.join(F.broadcast(hot), keys)
    many = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return few.unionByName(many.select(*few.columns))


def put_bytes(uri: str, data: bytes) -> None:
    """Write one file from a task, whole or not at all: a lost or doubled attempt leaves no torn file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    if isinstance(store, fs.LocalFileSystem):
        store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path.rpartition('/')[0]}/.{path.rpartition('/')[2]}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


@contextmanager
def open_bytes(uri: str) -> Iterator[Callable[[int, int], bytes]]:
    """read(offset, size) of a file that put_bytes wrote."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    with store.open_input_file(path) as f:
        yield lambda at, size: f.read_at(size, at)


def some(batches: Iterator, cost, most: int) -> Iterator[list]:
    """Lists of successive items whose summed cost reaches `most`; one dear item makes a list of its own."""
    held, sum_ = [], 0
    for x in batches:
        held.append(x)
        sum_ += cost(x)
        if sum_ >= most:
            yield held
            held, sum_ = [], 0
    if held:
        yield held


def fraction_for(bound: int, rows: int) -> float:
    """The share of `rows` whose expected number is `bound`; all of them when there are fewer."""
    return min(1.0, bound / max(1, rows))


def in_fraction(column, fraction) -> F.Column:
    """Whether a row's hash falls in the share: the same rows on every run and for every partitioning."""
    return F.pmod(F.xxhash64(F.lit("sample"), column), F.lit(1 << 20)) < F.lit(1 << 20) * fraction
