"""Sets of ranges that don't overlap: on the driver, and as rows (start, stop) of a DataFrame."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.functions.ranges import LongRange, block_of, cut_point, quotient


class OverlapError(ValueError):
    """A range overlaps one that is already there."""


class RangeSet:
    """An ordered set of ranges; adding one that overlaps leaves the set as it is and returns False."""

    def __init__(self, ranges: Iterable[LongRange] = ()):
        self._sorted: list[LongRange] = []
        for r in ranges:
            if not self.add(r):
                raise OverlapError(str(r))

    def __iter__(self) -> Iterator[LongRange]:
        return iter(list(self._sorted))

    def __reversed__(self) -> Iterator[LongRange]:
        return iter(self._sorted[::-1])

    def __len__(self) -> int:
        return len(self._sorted)

    def __contains__(self, r: LongRange) -> bool:
        k = bisect_left(self._sorted, r)
        return k < len(self._sorted) and self._sorted[k] == r

    def __eq__(self, other: object) -> bool:
        return isinstance(other, RangeSet) and self._sorted == other._sorted

    def __hash__(self) -> int:
        return hash(tuple(self._sorted))

    def add(self, r: LongRange) -> bool:
        k = bisect_left(self._sorted, r)
        if any(x.overlaps(r) for x in self._sorted[max(0, k - 1) : k + 1]):
            return False
        self._sorted.insert(k, r)
        return True

    def add_all(self, ranges: Iterable[LongRange]) -> bool:
        """Adds what doesn't overlap; True if the set changed."""
        return any([self.add(r) for r in ranges])

    def remove(self, r: LongRange) -> bool:
        """Removes exactly that range."""
        if r not in self:
            return False
        self._sorted.remove(r)
        return True

    def remove_all(self, ranges: Iterable[LongRange]) -> bool:
        return any([self.remove(r) for r in ranges])

    def retain_all(self, ranges: Iterable[LongRange]) -> bool:
        keep = set(ranges)
        before = len(self)
        self._sorted = [r for r in self._sorted if r in keep]
        return len(self) < before

    def contains_all(self, ranges: Iterable[LongRange]) -> bool:
        return all(r in self for r in ranges)

    def clear(self) -> None:
        self._sorted = []

    @property
    def total_size(self) -> int:
        return sum(r.size for r in self._sorted)

    def overlap(self, index: int) -> LongRange | None:
        """The range that holds an index."""
        k = bisect_right(self._sorted, index, key=lambda r: r.start) - 1
        return next((r for r in self._sorted[max(0, k - 1) : k + 1] if index in r), None)

    def contains_index(self, index: int) -> bool:
        return self.overlap(index) is not None

    def contains_range(self, r: LongRange) -> bool:
        """Whether all indices of ``r`` are held, by several adjacent ranges perhaps."""
        return r.covered_by(self._sorted)

    # -- neighbours in order: None if there is none

    def _at(self, k: int) -> LongRange | None:
        return self._sorted[k] if 0 <= k < len(self._sorted) else None

    def first(self) -> LongRange | None:
        return self._at(0)

    def last(self) -> LongRange | None:
        return self._at(len(self._sorted) - 1)

    def floor(self, r: LongRange) -> LongRange | None:
        return self._at(bisect_right(self._sorted, r) - 1)

    def lower(self, r: LongRange) -> LongRange | None:
        return self._at(bisect_left(self._sorted, r) - 1)

    def ceiling(self, r: LongRange) -> LongRange | None:
        return self._at(bisect_left(self._sorted, r))

    def higher(self, r: LongRange) -> LongRange | None:
        return self._at(bisect_right(self._sorted, r))

    def poll_first(self) -> LongRange | None:
        return self._sorted.pop(0) if self._sorted else None

    def poll_last(self) -> LongRange | None:
        return self._sorted.pop() if self._sorted else None

    # -- parts

    def head_set(self, stop: int | LongRange, overlap: bool = False, inclusive: bool = False) -> RangeSet:
        """Ranges before an index (``overlap``: and one that holds it), or before a range in order."""
        if isinstance(stop, LongRange):
            return RangeSet(r for r in self._sorted if r < stop or (inclusive and r == stop))
        return RangeSet(r for r in self._sorted if r.stop <= stop or (overlap and r.start < stop))

    def tail_set(self, start: int | LongRange, overlap: bool = False, inclusive: bool = True) -> RangeSet:
        """Ranges from an index on (``overlap``: and one that holds it), or from a range on in order."""
        if isinstance(start, LongRange):
            return RangeSet(r for r in self._sorted if r > start or (inclusive and r == start))
        return RangeSet(r for r in self._sorted if r.start >= start or (overlap and r.stop > start))

    def sub_set(self, low: LongRange, high: LongRange, low_inclusive: bool = True, high_inclusive: bool = False) -> RangeSet:
        return RangeSet(r for r in self.tail_set(low, inclusive=low_inclusive) if r < high or (high_inclusive and r == high))

    def include_set(self, start: int, stop: int) -> RangeSet:
        """Ranges that lie wholly in [start, stop)."""
        return RangeSet(r for r in self._sorted if r in LongRange(start, stop))

    def overlap_set(self, start: int, stop: int) -> RangeSet:
        """Ranges that overlap [start, stop)."""
        return RangeSet(r for r in self._sorted if r.overlaps(LongRange(start, stop)))

    def split(self, start: int, stop: int) -> RangeSet:
        """Cuts ranges at both points, in place, and returns those that then lie between them."""
        self._sorted = [x for r in self._sorted for x in (r.split_at(start, stop) if r.size else [r])]
        return self.include_set(start, stop)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r.start, r.stop) for r in self._sorted], "start long, stop long")

    @classmethod
    def of(cls, ranges: DataFrame) -> RangeSet:
        """From rows (start, stop): metadata of a list, a row a chunk."""
        return cls(LongRange(r.start, r.stop) for r in ranges.select("start", "stop").collect())


# ---- as rows ----------------------------------------------------------------------------------


def check_disjoint(ranges: DataFrame) -> DataFrame:
    """``ranges`` with a failing row if two of them overlap, found among neighbours in order of start."""
    before = F.max("stop").over(Window.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    same = F.lag("start").over(Window.orderBy("start", "stop"))
    clash = (before > F.col("start")) | ((same == F.col("start")) & (F.col("start") == F.col("stop")))
    checked = ranges.withColumn("__ok", F.assert_true(~F.coalesce(clash, F.lit(False)), "ranges overlap"))
    return checked.where(F.col("__ok").isNull()).drop("__ok")


def overlapping(ranges: DataFrame, start: int, stop: int) -> DataFrame:
    return ranges.where((F.col("start") < stop) & (F.col("stop") > start))


def including(ranges: DataFrame, start: int, stop: int) -> DataFrame:
    return ranges.where((F.col("start") >= start) & (F.col("stop") <= stop))


def cut(ranges: DataFrame, *points: int) -> DataFrame:
    """Ranges cut at those points that lie inside them; other columns are repeated."""
    inside = [F.when((F.col("start") < p) & (F.col("stop") > p), F.lit(p).cast("long")) for p in sorted(points)]
    edges = F.array_compact(F.array(F.col("start"), *inside, F.col("stop")))
    n = F.size("__edges")
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(F.element_at("__edges", k).alias("start"), F.element_at("__edges", k + 1).alias("stop")))
    rest = [c for c in ranges.columns if c not in ("start", "stop")]
    return ranges.withColumn("__edges", edges).select(*rest, F.explode(pairs).alias("__p")).select("__p.start", "__p.stop", *rest)


def intersect(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Non-empty intersections of the ranges of both, met by block of ``width`` indices."""
    from rangeloom.operators.interval import blocks

    left = blocks(a.select("start", "stop"), width).withColumnsRenamed({"start": "a", "stop": "b"})
    right = blocks(b.select("start", "stop"), width).withColumnsRenamed({"start": "c", "stop": "d"})
    low, high = F.greatest("a", "c"), F.least("b", "d")
    # A pair may share several blocks; the one where its common part begins counts.
    met = left.join(right, "block").where((low < high) & (block_of(low, width) == F.col("block")))
    return met.select(low.alias("start"), high.alias("stop"))


def total_size(ranges: DataFrame) -> DataFrame:
    return ranges.agg(F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).alias("total_size"))


def split_frame(ranges: DataFrame, parts: int) -> DataFrame:
    """(part, start, stop): the ranges dealt, in order, to parts of near-equal size, broken where one is full.

    The running total is over one row a range.
    """
    order = Window.orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("stop") - F.col("start")
    placed = ranges.select("start", "stop", F.sum(size).over(order).alias("__end"), F.sum(size).over(Window.partitionBy()).alias("__n"))
    n, k = F.col("__n"), F.col("part")
    low = k * quotient(n, parts) + F.least(k, n % parts)
    high = (k + 1) * quotient(n, parts) + F.least(k + 1, n % parts)
    begin = F.col("__end") - size
    out = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    out = out.withColumn("__a", F.greatest(begin, low)).withColumn("__b", F.least(F.col("__end"), high)).where("__a < __b")
    return out.select("part", (F.col("start") + F.col("__a") - begin).alias("start"), (F.col("start") + F.col("__b") - begin).alias("stop"))


__all__ = ["OverlapError", "RangeSet", "check_disjoint", "cut", "cut_point", "including", "intersect", "overlapping", "split_frame", "total_size"]
