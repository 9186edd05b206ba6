"""Half-open ranges of indices, squares of two of them, and column expressions over both.

A range is a small value on the driver; rows that lie in it are found by a predicate that Catalyst
pushes into the scan.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cut_point(start: int, size: int, parts: int, k: int) -> int:
    """Where part ``k`` of ``parts`` near-equal consecutive parts begins; the first ones take the remainder."""
    return start + k * (size // parts) + min(k, size % parts)


@dataclass(frozen=True, order=True)
class LongRange:
    """``[start, stop)``. Ordered by start, then stop; ``start == stop`` is a legal empty range."""

    start: int
    stop: int

    def __post_init__(self):
        if self.start > self.stop:
            raise ValueError(f"range from {self.start} to {self.stop}")

    @classmethod
    def at(cls, index: int) -> LongRange:
        """The empty range at ``index``, for look-ups."""
        return cls(index, index)

    @property
    def size(self) -> int:
        return self.stop - self.start

    def __iter__(self) -> Iterator[int]:
        return iter(range(self.start, self.stop))

    def __contains__(self, x: int | LongRange) -> bool:
        if isinstance(x, LongRange):
            return self.start <= x.start and x.stop <= self.stop
        return self.start <= x < self.stop

    def check(self, x: int | LongRange) -> None:
        """Raises IndexError unless ``x`` lies in this range."""
        if x not in self:
            raise IndexError(f"{x} is outside of {self}")

    def intersection(self, other: LongRange) -> LongRange | None:
        """The common part, or None if there is none; never an empty range."""
        low, high = max(self.start, other.start), min(self.stop, other.stop)
        return LongRange(low, high) if low < high else None

    def overlaps(self, other: LongRange) -> bool:
        """Whether indices are shared. Equal ranges overlap; an empty one overlaps a range that holds its place."""
        if self == other:
            return True
        if not self.size or not other.size:
            point, wide = (self, other) if not self.size else (other, self)
            return bool(wide.size) and point.start in wide
        return max(self.start, other.start) < min(self.stop, other.stop)

    def split(self, parts: int) -> list[LongRange]:
        cuts = [cut_point(self.start, self.size, parts, k) for k in range(parts + 1)]
        return [LongRange(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def split_at(self, *points: int) -> list[LongRange]:
        """Cut at those points that lie inside."""
        cuts = [self.start, *sorted({p for p in points if self.start < p < self.stop}), self.stop]
        return [LongRange(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]

    def covered_by(self, ranges: Iterable[LongRange]) -> bool:
        """Whether every index lies in one of ``ranges``; adjacent ones together count."""
        reached = self.start
        for r in sorted(ranges):
            if r.start > reached:
                break
            reached = max(reached, r.stop)
        return reached >= self.stop

    def where(self, idx: Column | str) -> Column:
        return (col(idx) >= self.start) & (col(idx) < self.stop)

    def frame(self, spark: SparkSession, name: str = "idx") -> DataFrame:
        """The indices as rows."""
        return spark.range(self.start, self.stop).withColumnRenamed("id", name)


def split_list(parts: int, ranges: Iterable[LongRange]) -> list[list[LongRange]]:
    """``parts`` lists of near-equal total size; ranges are broken where a list is full."""
    pieces, place = [], 0
    for r in ranges:
        pieces.append((place, r))
        place += r.size
    out: list[list[LongRange]] = []
    for k in range(parts):
        mine = LongRange(cut_point(0, place, parts, k), cut_point(0, place, parts, k + 1))
        met = [(at, r, mine.intersection(LongRange(at, at + r.size))) for at, r in pieces]
        out.append([LongRange(r.start + x.start - at, r.start + x.stop - at) for at, r, x in met if x])
    return out


def chunk_order(r: LongRange) -> tuple[int, int]:
    """Sort key of chunks: by start, of those that start together the longest first."""
    return (r.start, -r.stop)


def slice_bounds(total: int, parts: int, k: int, start: int = 0) -> tuple[int, int]:
    """Bounds of the k-th of ``parts`` near-equal slices of ``total`` items that begin at ``start``."""
    return cut_point(start, total, parts, k), cut_point(start, total, parts, k + 1)


@dataclass(frozen=True)
class SquareRange:
    """Pairs (i, j) with i in ``outer``, j in ``inner`` and, in an upper triangle, ``j >= i + 1 - shift``."""

    outer: LongRange
    inner: LongRange
    triangle: bool = False
    shift: int = 0

    def columns(self, i: int) -> LongRange:
        """The j that go with ``i``."""
        low = max(self.inner.start, i + 1 - self.shift) if self.triangle else self.inner.start
        return LongRange(min(low, self.inner.stop), self.inner.stop)

    def rows(self, j: int) -> LongRange:
        """The i that go with ``j``."""
        high = min(self.outer.stop, j + self.shift) if self.triangle else self.outer.stop
        return LongRange(self.outer.start, max(high, self.outer.start))

    def __contains__(self, x: tuple[int, int] | SquareRange) -> bool:
        if isinstance(x, SquareRange):
            if x.outer not in self.outer or x.inner not in self.inner:
                return False
            if not self.triangle:
                return True
            # In a rectangle the corner nearest to the diagonal decides, in a triangle its own diagonal may.
            corner = x.inner.start >= x.outer.stop - self.shift
            return corner or (x.triangle and x.shift <= self.shift)
        i, j = x
        return i in self.outer and j in self.columns(i)

    def check(self, x: tuple[int, int] | SquareRange) -> None:
        if x not in self:
            raise IndexError(f"{x} is outside of {self}")

    @property
    def size(self) -> int:
        """The number of pairs, counted as they are visited."""
        if not self.triangle:
            return self.outer.size * self.inner.size
        # j >= i + 1 - shift: whole columns for small i, then one less for each i, then none.
        full_until = max(self.outer.start, min(self.outer.stop, self.inner.start + self.shift))
        some_until = max(full_until, min(self.outer.stop, self.inner.stop + self.shift - 1))
        n = some_until - full_until
        most = self.inner.stop - (full_until + 1 - self.shift)
        return (full_until - self.outer.start) * self.inner.size + (n * most - n * (n - 1) // 2)

    def intersection(self, other: SquareRange) -> SquareRange | None:
        """The common part of both, a triangle if one of them is; None if an axis has nothing in common."""
        outer, inner = self.outer.intersection(other.outer), self.inner.intersection(other.inner)
        if outer is None or inner is None:
            return None
        shifts = [x.shift for x in (self, other) if x.triangle]
        return SquareRange(outer, inner, bool(shifts), min(shifts, default=0))

    def overlaps(self, other: SquareRange) -> bool:
        common = self.intersection(other)
        return common is not None and common.size > 0

    def split(self, outer: int, inner: int) -> list[SquareRange]:
        """Tiles in row order, each still bounded by the triangle; tiles without a pair are kept."""
        return [replace(self, outer=a, inner=b) for a in self.outer.split(outer) for b in self.inner.split(inner)]

    def translate(self, outer: int, inner: int) -> SquareRange:
        """Moved along both axes, as a rectangle."""
        return SquareRange(
            LongRange(self.outer.start + outer, self.outer.stop + outer), LongRange(self.inner.start + inner, self.inner.stop + inner)
        )

    def where(self, i: Column | str, j: Column | str) -> Column:
        found = self.outer.where(i) & self.inner.where(j)
        return found & (col(j) >= col(i) + (1 - self.shift)) if self.triangle else found

    def frame(self, spark: SparkSession, i: str = "i", j: str = "j") -> DataFrame:
        """The pairs as rows: the inner indices are generated for each outer one, so no pair is made to be dropped."""
        low = F.greatest(F.lit(self.inner.start), F.col(i) + (1 - self.shift)) if self.triangle else F.lit(self.inner.start)
        rows = self.outer.frame(spark, i).withColumn("__low", low.cast("long")).where(F.col("__low") < self.inner.stop)
        return rows.select(i, F.explode(F.sequence(F.col("__low"), F.lit(self.inner.stop - 1).cast("long"))).alias(j))


def split_squares(parts: int, squares: list[SquareRange], seed: int | None = None) -> list[list[SquareRange]]:
    """Tiles dealt to ``parts`` lists of near-equal length, in order or shuffled by a seed."""
    own = list(squares)
    if seed is not None:
        random.Random(seed).shuffle(own)
    cuts = [cut_point(0, len(own), parts, k) for k in range(parts + 1)]
    return [own[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def split_two_levels(hosts: int, workers: int, squares: list[SquareRange], seed: int | None = None) -> list[list[list[SquareRange]]]:
    """Tiles dealt to hosts, and each host's to its workers."""
    return [split_squares(workers, own) for own in split_squares(hosts, squares, seed)]


# ---- columns ----------------------------------------------------------------------------------


def holds_index(start: Column | str, stop: Column | str, idx: Column | str) -> Column:
    return (col(idx) >= col(start)) & (col(idx) < col(stop))


def holds_range(start: Column | str, stop: Column | str, other_start: Column | str, other_stop: Column | str) -> Column:
    return (col(start) <= col(other_start)) & (col(other_stop) <= col(stop))


def ranges_overlap(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> Column:
    """Whether [a, b) and [c, d) overlap, by the rules of :meth:`LongRange.overlaps`."""
    a, b, c, d = map(col, (a, b, c, d))
    equal = (a == c) & (b == d)
    point = ((a == b) & (c <= a) & (a < d)) | ((c == d) & (a <= c) & (c < b))
    return equal | point | ((a < b) & (c < d) & (F.greatest(a, c) < F.least(b, d)))


def range_intersection(a: Column | str, b: Column | str, c: Column | str, d: Column | str) -> Column:
    """STRUCT<start, stop> of the common part, null if there is none."""
    low, high = F.greatest(col(a), col(c)), F.least(col(b), col(d))
    return F.when(low < high, F.struct(low.alias("start"), high.alias("stop")))


def quotient(a: Column, b: Column | int) -> Column:
    """Integer division, exact for all longs that aren't negative."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def block_of(idx: Column | str, width: int) -> Column:
    """The number of the block of ``width`` indices that holds an index, negative ones too; exact for all longs."""
    i = col(idx).cast("long")
    return quotient(i - F.pmod(i, F.lit(width).cast("long")), F.lit(width).cast("long"))


def part_of(position: Column | str, total: Column | int, parts: int) -> Column:
    """The part, of ``parts`` near-equal ones, that a position (from 0) falls into."""
    p, n = col(position), F.lit(total) if isinstance(total, int) else total
    small = quotient(n, parts)
    extra = n - small * parts
    wide = extra * (small + 1)
    return F.when(p < wide, quotient(p, small + 1)).otherwise(extra + quotient(p - wide, F.greatest(small, F.lit(1).cast("long")))).cast("int")


def part_start(k: Column | str, total: int, parts: int) -> Column:
    """The position at which a part begins, as :func:`part_of` deals them."""
    return col(k).cast("long") * (total // parts) + F.least(col(k).cast("long"), F.lit(total % parts).cast("long"))


def null_safe_equals(a: Column | str, b: Column | str) -> Column:
    return col(a).eqNullSafe(col(b))
