"""Bags: rows without an order or a key, repeats allowed. ``list_id`` (optional) tells the lists a bag is made of."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.functions.ranges import part_of
from rangeloom.operators.reduce import Reducer, reduce_with
from rangeloom.operators.repeat import repeated


class BagFrame:
    """Reducing a bag leaves it as it is; a drained bag is one whose handle was dropped."""

    LIST = "list_id"

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def of_lists(cls, spark: SparkSession, lists: Iterable[Iterable[Any]], name: str = "value", kind: str = "long") -> BagFrame:
        rows = [(k, v) for k, own in enumerate(lists) for v in own]
        return cls(spark.createDataFrame(rows, f"{cls.LIST} int, `{name}` {kind}"))

    def add(self, other: BagFrame) -> BagFrame:
        """Both bags' rows, repeats kept; lists of the other get numbers of their own."""
        right = other.df
        if self.LIST in self.df.columns and self.LIST in right.columns:
            top = self.df.agg(F.coalesce(F.max(self.LIST), F.lit(-1)) + 1).first()[0]
            right = right.withColumn(self.LIST, (F.col(self.LIST) + top).cast("int"))
        return BagFrame(self.df.unionByName(right, allowMissingColumns=True))

    add_bag = union = add

    def receive(self, rows: DataFrame) -> BagFrame:
        """With the rows that a flat map or a stream's batch delivers."""
        return BagFrame(self.df.unionByName(rows, allowMissingColumns=True))

    def clone(self) -> BagFrame:
        return BagFrame(self.df)

    def for_each(self, action: Callable[[Iterable[Row]], None], parallelism: int | None = None) -> None:
        (self.df.repartition(parallelism) if parallelism else self.df).foreachPartition(action)

    def map(self, **values: Column) -> BagFrame:
        return BagFrame(self.df.select(*[v.alias(k) for k, v in values.items()]))

    def contains(self, name: str, value: Any) -> bool:
        return not self.df.where(F.col(name).eqNullSafe(F.lit(value))).isEmpty()

    def contains_all(self, values: DataFrame, name: str) -> bool:
        v = values.columns[0]
        own = self.df.select(F.col(name).alias("__v")).distinct()
        return values.join(own, F.col(v).eqNullSafe(F.col("__v")), "left_anti").isEmpty()

    def reduce(self, **reductions: Column) -> DataFrame:
        return self.df.agg(*[c.alias(k) for k, c in reductions.items()])

    def reduce_with(self, reducer: Reducer, *columns: str) -> Any:
        return reduce_with(self.df, reducer, *columns)

    def reduce_lists(self, per_list: dict[str, Column], final: dict[str, Column] | None = None) -> DataFrame:
        """Aggregates of each list; with ``final`` aggregates over those."""
        out = self.df.groupBy(self.LIST).agg(*[c.alias(k) for k, c in per_list.items()])
        return out.agg(*[c.alias(k) for k, c in final.items()]) if final else out

    def remove(self, n: int = 1) -> tuple[DataFrame, BagFrame]:
        """Some ``n`` rows, the same ones whenever it is worked out, and the bag without them. A row that
        occurs several times loses one occurrence for each taken."""
        taken = self.df.orderBy(F.xxhash64(*self.df.columns), *self.df.columns).limit(n)
        return taken, BagFrame(self.df.exceptAll(taken))

    def with_part(self, parts: int, *order: str, name: str = "part", blocks: int = 4096) -> DataFrame:
        """Rows with a part, sizes at most one apart.

        Equal rows are one row with a number until their places are known. Rows are dealt to hash blocks,
        blocks are counted and get their first position from a scan over the counts, and rows are numbered
        inside their block; so no row fills a block, however often it occurs, and places don't change between runs.
        """
        names = self.df.columns
        by = order or tuple(names)
        keyed = self.df.groupBy(*names).agg(F.count(F.lit(1)).alias("__m")).withColumn("__b", F.pmod(F.xxhash64(*by, *names), F.lit(blocks)))
        counts = keyed.groupBy("__b").agg(F.sum("__m").alias("__c"))
        before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__s"), F.sum("__c").over(Window.partitionBy()).alias("__n"))
        inside = Window.partitionBy("__b").orderBy(*by, *[c for c in names if c not in by]).rowsBetween(Window.unboundedPreceding, 0)
        numbered = keyed.withColumn("__rn", F.sum("__m").over(inside) - F.col("__m"))
        met = repeated(numbered.join(F.broadcast(starts), "__b"), "__m", "__k")  # at most ``blocks`` starts
        return met.withColumn(name, part_of(F.col("__s") + F.col("__rn") + F.col("__k"), F.col("__n"), parts)).drop("__b", "__rn", "__s", "__n", "__m", "__k")

    def separate(self, parts: int) -> list[BagFrame]:
        """``parts`` bags, sizes at most one apart, that together hold all rows."""
        dealt = self.with_part(parts, name="__part")
        return [BagFrame(dealt.where(F.col("__part") == k).drop("__part")) for k in range(parts)]

    def convert_to_list(self) -> list[Row]:
        """All rows on the driver: for small bags."""
        return self.df.collect()

    def size(self) -> int:
        return self.df.count()

    def list_count(self) -> int:
        return self.df.select(self.LIST).distinct().count() if self.LIST in self.df.columns else self.df.rdd.getNumPartitions()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def write(self, path: str) -> None:
        self.df.write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> BagFrame:
        return cls(spark.read.parquet(path))
