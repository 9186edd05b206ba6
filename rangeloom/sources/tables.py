"""Reading and writing lists and bags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rangeloom.operators.bag import BagFrame
from rangeloom.operators.indexed import IndexedFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def indexed(spark: SparkSession, sf_dir: str, name: str, idx: str) -> IndexedFrame:
    """A table with a unique long column as a list."""
    return IndexedFrame(table(spark, sf_dir, name), idx)


def bag(spark: SparkSession, sf_dir: str, name: str) -> BagFrame:
    return BagFrame(table(spark, sf_dir, name))


def write_ranged(x: IndexedFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Written in index order, range by range, so that slices read few files and row groups."""
    x.df.repartitionByRange(x.idx).sortWithinPartitions(x.idx).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_bucketed(x: IndexedFrame, name: str, buckets: int) -> None:
    """As a table bucketed and sorted by index: lists written alike are zipped without a shuffle."""
    x.df.write.mode("overwrite").bucketBy(buckets, x.idx).sortBy(x.idx).saveAsTable(name)
