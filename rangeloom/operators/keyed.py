"""Maps: rows (key, value...), maps of long keys restricted to ranges, and multimaps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from rangeloom.functions.ranges import LongRange
from rangeloom.operators.bag import BagFrame
from rangeloom.operators.indexed import RangesFilter
from rangeloom.operators.rangeset import OverlapError, RangeSet


class KeyedFrame:
    """``df`` with a unique column ``key``. ``default``: columns for keys that are looked up and missing, by name, over the key."""

    def __init__(self, df: DataFrame, key: str = "key", default: dict[str, Column] | None = None):
        self.df, self.key, self.default = df, key, default or {}

    def _with(self, df: DataFrame) -> KeyedFrame:
        return KeyedFrame(df, self.key, self.default)

    def set_default(self, **values: Column) -> KeyedFrame:
        """With values that a look-up of a missing key gives; they aren't stored."""
        return KeyedFrame(self.df, self.key, values)

    def get(self, key: Any) -> Row | None:
        """The row of a key; if it is missing, that of the default, or None."""
        row = self.df.where(F.col(self.key).eqNullSafe(F.lit(key))).first()
        if row is None and self.default:
            row = self.df.sparkSession.range(1).select(F.lit(key).alias(self.key)).withColumns(self.default).first()
        return row

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``keys`` (column ``key``, others kept) with this map's columns; missing keys get the default, or nulls."""
        right = self.df.withColumnRenamed(self.key, "__k").withColumn("__hit", F.lit(True))
        out = keys.join(right, F.col(self.key) == F.col("__k"), "left").drop("__k")
        filled = {c: F.when(F.col("__hit"), F.col(c)).otherwise(d) for c, d in self.default.items()}
        return out.withColumns(filled).drop("__hit") if filled else out.drop("__hit")

    def contains_key(self, key: Any) -> bool:
        return not self.df.where(F.col(self.key).eqNullSafe(F.lit(key))).isEmpty()

    def contains_value(self, name: str, value: Any) -> bool:
        return not self.df.where(F.col(name).eqNullSafe(F.lit(value))).isEmpty()

    def put_all(self, rows: DataFrame) -> KeyedFrame:
        """With ``rows``, which replace those with the same keys."""
        kept = self.df.join(rows.select(F.col(self.key).alias("__k")), F.col(self.key).eqNullSafe(F.col("__k")), "left_anti")
        return self._with(kept.unionByName(rows))

    def put(self, key: Any, **values: Any) -> KeyedFrame:
        row = self.df.sparkSession.range(1).select(*[F.lit(key if c == self.key else values.get(c)).cast(t).alias(c) for c, t in self.df.dtypes])
        return self.put_all(row)

    def remove(self, *keys: Any) -> KeyedFrame:
        return self._with(self.df.where(~F.coalesce(F.col(self.key).isin(*keys), F.lit(False))))

    delete = remove

    def remove_all(self, keys: DataFrame) -> tuple[DataFrame, KeyedFrame]:
        """The rows of those keys, and the map without them."""
        k = keys.select(F.col(keys.columns[0]).alias("__k"))
        on = F.col(self.key).eqNullSafe(F.col("__k"))
        return self.df.join(k, on, "left_semi"), self._with(self.df.join(k, on, "left_anti"))

    def map(self, **values: Column) -> KeyedFrame:
        """The same keys with new values."""
        return KeyedFrame(self.df.select(self.key, *[v.alias(k) for k, v in values.items()]), self.key)

    def for_each(self, action: Callable[[Iterable[Row]], None], parallelism: int | None = None) -> None:
        (self.df.repartition(parallelism) if parallelism else self.df).foreachPartition(action)

    def reduce(self, **reductions: Column) -> DataFrame:
        """Reductions of all values; as rows have no order they must be associative and commutative."""
        return self.df.agg(*[c.alias(k) for k, c in reductions.items()])

    def separate_keys(self, parts: int, name: str = "part") -> DataFrame:
        """Rows with a part by the hash of the key."""
        return self.df.withColumn(name, F.pmod(F.xxhash64(self.key), F.lit(parts)).cast("int"))

    def separate_values(self, parts: int, name: str = "part") -> DataFrame:
        """Rows with a part, sizes at most one apart."""
        return BagFrame(self.df).with_part(parts, self.key, name=name)

    def keys(self) -> DataFrame:
        return self.df.select(self.key)

    def values(self) -> DataFrame:
        return self.df.drop(self.key)

    def size(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()


class RangedKeyedFrame(KeyedFrame):
    """A map of long keys that may only lie in declared ranges. Its size is that of the ranges; ``count`` is that of its rows."""

    def __init__(self, df: DataFrame, ranges: Sequence[LongRange] = (), key: str = "key"):
        super().__init__(df, key)
        self.ranges = sorted(ranges)

    def add_range(self, r: LongRange, **initial: Column) -> RangedKeyedFrame:
        """With one more range; with ``initial``, columns over the key, it is filled."""
        if any(r.overlaps(x) for x in self.ranges):
            raise OverlapError(str(r))
        df = self.df
        if initial:
            rows = r.frame(df.sparkSession, self.key).withColumns(initial)
            df = df.unionByName(rows, allowMissingColumns=True)
        return RangedKeyedFrame(df, [*self.ranges, r], self.key)

    def put_all(self, rows: DataFrame) -> RangedKeyedFrame:
        """As for any map; a key outside of the ranges fails when rows are read."""
        inside = F.lit(False)
        for r in self.ranges:
            inside |= r.where(self.key)
        message = F.concat(F.lit("no range holds key "), F.col(self.key).cast("string"))
        checked = rows.withColumn(self.key, F.when(inside, F.col(self.key)).otherwise(F.raise_error(message).cast("long")))
        kept = self.df.join(rows.select(F.col(self.key).alias("__k")), F.col(self.key) == F.col("__k"), "left_anti")
        return RangedKeyedFrame(kept.unionByName(checked), self.ranges, self.key)

    def size(self) -> int:
        return sum(r.size for r in self.ranges)

    def count(self) -> int:
        return self.df.count()

    def contains_range(self, r: LongRange) -> bool:
        return r.covered_by(self.ranges)

    def within(self, r: LongRange) -> DataFrame:
        if not self.contains_range(r):
            raise IndexError(str(r))
        return self.df.where(r.where(self.key))

    def remove_range(self, r: LongRange) -> tuple[DataFrame, RangedKeyedFrame]:
        """Rows of exactly that range, and the map without rows and range."""
        if r not in self.ranges:
            raise KeyError(str(r))
        rest = [x for x in self.ranges if x != r]
        return self.df.where(r.where(self.key)), RangedKeyedFrame(self.df.where(~r.where(self.key)), rest, self.key)

    def split(self, r: LongRange) -> RangedKeyedFrame:
        """The part of the map in ``r``, with ranges cut at its ends."""
        ranges = list(RangeSet(self.ranges).split(r.start, r.stop))
        return RangedKeyedFrame(self.df.where(r.where(self.key)), ranges, self.key)

    def clone_range(self, r: LongRange) -> RangedKeyedFrame:
        ranges = [x for x in (r.intersection(own) for own in self.ranges) if x]
        return RangedKeyedFrame(RangesFilter(ranges).of(self.df, self.key), ranges, self.key)


class MultiMap:
    """Rows (key, value): a key may have several values."""

    def __init__(self, df: DataFrame, key: str = "key", value: str = "value"):
        self.df, self.key, self.value = df, key, value

    def put(self, rows: DataFrame) -> MultiMap:
        return MultiMap(self.df.unionByName(rows), self.key, self.value)

    def get(self, key: Any) -> DataFrame:
        return self.df.where(F.col(self.key).eqNullSafe(F.lit(key))).select(self.value)

    def grouped(self) -> DataFrame:
        """(key, values): a sorted array a key, for keys whose values fit in one row."""
        return self.df.groupBy(self.key).agg(F.array_sort(F.collect_list(self.value)).alias("values"))

    def counts(self) -> DataFrame:
        return self.df.groupBy(self.key).agg(F.count(F.lit(1)).alias("n"))

    def size(self) -> int:
        """The number of keys."""
        return self.df.select(self.key).distinct().count()
