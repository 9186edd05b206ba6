"""Lists addressed by a long index: rows (idx, payload...) and the ranges (start, stop) they lie in.

Lists are immutable: what changes elements in place elsewhere returns a new frame here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.functions.ranges import LongRange, block_of, part_of, split_list
from rangeloom.operators.interval import range_join, scanned, small
from rangeloom.operators.local import local_batches
from rangeloom.operators.rangeset import OverlapError, RangeSet, cut
from rangeloom.operators.reduce import Reducer, reduce_with

if TYPE_CHECKING:
    from rangeloom.operators.bag import BagFrame
    from rangeloom.operators.product import Product


class IndexedFrame:
    """``df`` with a unique long column ``idx``; ``ranges`` (optional) are the chunks it was made of."""

    def __init__(self, df: DataFrame, idx: str = "idx", ranges: Sequence[LongRange] | None = None):
        self.df, self.idx = df, idx
        self._ranges = None if ranges is None else sorted(ranges, key=lambda r: (r.start, -r.stop))

    # ---- making one

    @classmethod
    def generate(cls, spark: SparkSession, r: LongRange, **values: Column | Any) -> IndexedFrame:
        """Each index of ``r`` with values of expressions over ``idx``, constants or typed nulls."""
        df = r.frame(spark).select("idx", *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])
        return cls(df, ranges=[r])

    @classmethod
    def empty(cls, spark: SparkSession, r: LongRange, **types: str) -> IndexedFrame:
        """Each index of ``r`` with nulls of the types named."""
        return cls.generate(spark, r, **{k: F.lit(None).cast(t) for k, t in types.items()})

    @classmethod
    def from_values(cls, spark: SparkSession, r: LongRange, values: Sequence[Any], name: str = "value", kind: str | None = None) -> IndexedFrame:
        """The values of a list at the indices of ``r``; there must be as many."""
        if len(values) != r.size:
            raise ValueError(f"{len(values)} values for {r.size} indices")
        schema = f"idx long, `{name}` {kind}" if kind else ["idx", name]
        return cls(spark.createDataFrame(list(zip(r, values, strict=True)), schema), ranges=[r])

    def _with(self, df: DataFrame, ranges: Sequence[LongRange] | None = None) -> IndexedFrame:
        return IndexedFrame(df, self.idx, self._ranges if ranges is None else ranges)

    # ---- chunks

    @property
    def ranges(self) -> list[LongRange]:
        """The chunks' ranges, in order: metadata on the driver, an entry a chunk. Unknown ones are worked out
        from gaps between indices; for indices full of gaps use :meth:`runs`, which stays a table."""
        if self._ranges is None:
            rows = self.runs().collect()
            self._ranges = sorted(LongRange(r.start, r.stop) for r in rows)
        return list(self._ranges)

    def runs(self, width: int = 1 << 20) -> DataFrame:
        """(start, stop) of each run of consecutive indices. Runs within blocks of ``width`` indices come
        first. Those at which none ends begin a run, those at which none begins end one, and the n-th
        beginning goes with the n-th end."""
        i = F.col(self.idx)
        rank = F.row_number().over(Window.partitionBy(block_of(i, width)).orderBy(self.idx))
        parts = self.df.select(i.alias("i"), block_of(i, width).alias("b"), (i - rank).alias("g")).groupBy("b", "g")
        parts = parts.agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"))
        begins = parts.select("start").join(parts.select(F.col("stop").alias("x")), F.col("start") == F.col("x"), "left_anti")
        ends = parts.select("stop").join(parts.select(F.col("start").alias("x")), F.col("stop") == F.col("x"), "left_anti")
        first, last = positions(begins, "start").drop("__n"), positions(ends, "stop").drop("__n")
        return first.join(last, "__pos").select("start", "stop")

    @property
    def num_chunks(self) -> int:
        return len(self.ranges)

    def ranges_frame(self) -> DataFrame:
        """(range_id, start, stop) of the chunks; of unknown ones without gathering them."""
        if self._ranges is None:
            return positions(self.runs(), "start").select(F.col("__pos").alias("range_id"), "start", "stop")
        rows = [(k, r.start, r.stop) for k, r in enumerate(self.ranges)]
        return self.df.sparkSession.createDataFrame(rows, "range_id long, start long, stop long")

    def chunks(self, overlapping: LongRange | None = None) -> DataFrame:
        """Rows with range_id, start and stop of their chunk; ``overlapping``: of chunks that meet it only."""
        ranges = self.ranges_frame()
        if overlapping is not None:
            ranges = ranges.where((F.col("start") < overlapping.stop) & (F.col("stop") > overlapping.start))
        return range_join(self.df, ranges, self.idx)

    def chunk(self, r: LongRange) -> IndexedFrame:
        """The chunk with exactly that range."""
        if r not in self.ranges:
            raise KeyError(str(r))
        return self._with(self.df.where(r.where(self.idx)), [r])

    def contains_chunk(self, r: LongRange) -> bool:
        return r in self.ranges

    def contains_index(self, i: int) -> bool:
        if self._ranges is None:
            return not self.df.where(F.col(self.idx) == i).isEmpty()
        return any(i in r for r in self._ranges)

    def contains_range(self, r: LongRange) -> bool:
        """Whether all of ``r`` lies in chunks, adjacent ones together perhaps."""
        if self._ranges is None:
            return self.df.where(r.where(self.idx)).count() == r.size
        return r.covered_by(self._ranges)

    def add(self, other: IndexedFrame) -> IndexedFrame:
        """With the chunks of ``other``, none of which may overlap one that is there."""
        own = other.df.withColumnRenamed(other.idx, self.idx)
        if self._ranges is None or other._ranges is None:  # chunks unknown: their indices tell
            shared = own.select(self.idx).join(self.df.select(F.col(self.idx).alias("__i")), F.col(self.idx) == F.col("__i"), "left_semi").head()
            if shared is not None:
                raise OverlapError(f"index {shared[0]} is in both")
            return IndexedFrame(self.df.unionByName(own), self.idx)
        mine = RangeSet(self.ranges)
        for r in other.ranges:
            if mine.overlap_set(r.start, r.stop):
                raise OverlapError(str(r))
        return self._with(self.df.unionByName(own), self.ranges + other.ranges)

    def remove(self, r: LongRange) -> IndexedFrame:
        """Without the chunk that has exactly that range."""
        if self._ranges is None:
            if self.runs().where((F.col("start") == r.start) & (F.col("stop") == r.stop)).isEmpty():
                raise KeyError(str(r))
            return IndexedFrame(self.df.where(~r.where(self.idx)), self.idx)
        if r not in self.ranges:
            raise KeyError(str(r))
        return self._with(self.df.where(~r.where(self.idx)), [x for x in self.ranges if x != r])

    def filter_chunks(self, condition: Column, **aggregates: Column) -> IndexedFrame:
        """Chunks for whose ``aggregates`` the condition holds; aggregated once, then slices of the list."""
        kept = self.chunks().groupBy("range_id", "start", "stop").agg(*[c.alias(k) for k, c in aggregates.items()]).where(condition)
        ranges = sorted(LongRange(r.start, r.stop) for r in kept.select("start", "stop").collect())
        return self._with(RangesFilter(ranges).of(self.df, self.idx), ranges)

    def reduce_chunks(self, **aggregates: Column) -> DataFrame:
        """A row a chunk: range_id, start, stop and the aggregates."""
        return self.chunks().groupBy("range_id", "start", "stop").agg(*[c.alias(k) for k, c in aggregates.items()])

    def reduce_blocks(self, width: int, **aggregates: Column) -> DataFrame:
        """A row for each block of ``width`` indices that has elements: range_id, start, stop, aggregates."""
        k = block_of(self.idx, width)
        out = self.df.groupBy(k.alias("range_id")).agg(*[c.alias(n) for n, c in aggregates.items()])
        return out.select("range_id", (F.col("range_id") * width).alias("start"), ((F.col("range_id") + 1) * width).alias("stop"), *aggregates)

    def split_chunks(self, r: LongRange) -> IndexedFrame:
        """With chunks cut so that ``r`` is made of whole ones, of which the result consists."""
        pieces = [x for own in self.ranges for x in own.split_at(r.start, r.stop)]
        return self._with(self.df.where(r.where(self.idx)), [x for x in pieces if x in r])

    def split_at(self, *points: int) -> list[IndexedFrame]:
        return [self._with(self.df.where(x.where(self.idx)), [x]) for own in self.ranges for x in own.split_at(*points)]

    def separate(self, parts: int) -> list[IndexedFrame]:
        """``parts`` lists of near-equal size by the chunks' ranges, in order."""
        return [self._with(RangesFilter(ranges).of(self.df, self.idx), ranges) for ranges in split_list(parts, self.ranges)]

    def with_part(self, parts: int, name: str = "part") -> DataFrame:
        """Rows with their part among ``parts`` near-equal ones in index order, gaps or not.

        Positions come from counts of index blocks, so that nothing is sorted in one place.
        """
        return positions(self.df, self.idx).withColumn(name, part_of("__pos", F.col("__n"), parts)).drop("__pos", "__n")

    # ---- rows

    def get(self, i: int) -> Row:
        """The row at an index, IndexError if there is none."""
        row = self.df.where(F.col(self.idx) == i).first()
        if row is None:
            raise IndexError(i)
        return row

    def set(self, i: int, **values: Column | Any) -> IndexedFrame:
        if not self.contains_index(i):
            raise IndexError(i)
        return self.set_unchecked(i, **values)

    def get_unchecked(self, i: int) -> Row | None:
        """The row at an index, None if there is none."""
        return self.df.where(F.col(self.idx) == i).first()

    def set_unchecked(self, i: int, **values: Column | Any) -> IndexedFrame:
        """As ``set`` without looking whether the index is there; if it isn't nothing changes."""
        at = F.col(self.idx) == i
        return self._with(self.df.withColumns({k: F.when(at, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(k)) for k, v in values.items()}))

    def slice(self, r: LongRange) -> IndexedFrame:
        """What lies in ``r``; nothing if no chunk meets it."""
        ranges = None if self._ranges is None else [x for x in (r.intersection(own) for own in self._ranges) if x]
        return IndexedFrame(self.df.where(r.where(self.idx)), self.idx, ranges)

    def sub_list(self, r: LongRange) -> IndexedFrame:
        """What lies in ``r``, clipped to the list; IndexError if nothing does."""
        part = self.slice(r)
        if not part._ranges if part._ranges is not None else part.df.isEmpty():
            raise IndexError(str(r))
        return part

    def range_check(self, r: LongRange) -> None:
        if not self.contains_range(r):
            raise IndexError(str(r))

    def slices(self, ranges: DataFrame) -> DataFrame:
        """Rows in any of the ranges (start, stop, ...), once a range that holds them, with its columns."""
        return range_join(self.df, ranges, self.idx)

    def iterate(self, r: LongRange | None = None, start: int | None = None, reverse: bool = False) -> Iterator[Row]:
        """Rows in index order, from ``start`` on, to the driver a partition at a time."""
        df = self.df if r is None else self.df.where(r.where(self.idx))
        if start is not None:
            df = df.where(F.col(self.idx) <= start if reverse else F.col(self.idx) >= start)
        return df.orderBy(F.desc(self.idx) if reverse else F.asc(self.idx)).toLocalIterator()

    def to_list(self, *columns: str) -> list[Row]:
        """All rows in order on the driver: for small lists."""
        return self.df.orderBy(self.idx).select(*(columns or ["*"])).collect()

    # ---- map, zip, flat map

    def map(self, **values: Column | str) -> IndexedFrame:
        """The same indices with new columns; expressions may use the index and all columns."""
        return self._with(self.df.select(self.idx, *[(F.expr(v) if isinstance(v, str) else v).alias(k) for k, v in values.items()]))

    lazy_map = map

    def update(self, within: LongRange | None = None, **values: Column) -> IndexedFrame:
        """All columns, some with new values (in ``within`` only, if given)."""
        new = values if within is None else {k: F.when(within.where(self.idx), v).otherwise(F.col(k)) for k, v in values.items()}
        return self._with(self.df.withColumns(new))

    def map_batches(self, function: Callable, schema: str, make: Callable[[], Any] | None = None) -> IndexedFrame:
        """A function over Arrow batches, for what expressions can't say; it must keep the index column. With ``make``
        it is a function of an object, which each task makes for itself, and a batch."""
        return self._with(local_batches(self.df, function, schema, make))

    def for_each(self, action: Callable[[Iterable[Row]], None], within: LongRange | None = None) -> None:
        """A side effect on each partition's rows."""
        (self.df if within is None else self.df.where(within.where(self.idx))).foreachPartition(action)

    def zip_for_each(self, other: IndexedFrame, action: Callable[[Iterable[Row]], None], within: LongRange | None = None) -> None:
        """A side effect on each partition's rows met by index, see :meth:`zipped`."""
        self.zipped(other, within=within).foreachPartition(action)

    def zipped(self, *others: IndexedFrame, within: LongRange | None = None) -> DataFrame:
        """Rows met by index; columns of the k-th other list (from 1) begin with ``rk_``."""
        out = self.df if within is None else self.df.where(within.where(self.idx))
        for k, o in enumerate(others, 1):
            right = o.df.select(F.col(o.idx).alias("__i"), *[F.col(c).alias(f"r{k}_{c}") for c in o.df.columns if c != o.idx])
            out = out.join(right, out[self.idx] == right["__i"]).drop("__i")
        return out

    def zip_map(self, other: IndexedFrame, within: LongRange | None = None, **values: Column) -> IndexedFrame:
        return IndexedFrame(self.zipped(other, within=within).select(self.idx, *[v.alias(k) for k, v in values.items()]), self.idx)

    def setup_from(self, *sources: IndexedFrame, within: LongRange | None = None, **values: Column) -> IndexedFrame:
        """This list with columns overwritten where all ``sources`` have the index (columns ``rk_...``)."""
        found = self.zipped(*sources, within=within).select(F.col(self.idx).alias("__i"), *[v.alias(f"__new_{k}") for k, v in values.items()])
        met = self.df.join(found.withColumn("__hit", F.lit(True)), self.df[self.idx] == found["__i"], "left")
        new = {k: F.when(F.col("__hit"), F.col(f"__new_{k}")).otherwise(F.col(k)) if k in self.df.columns else F.col(f"__new_{k}") for k in values}
        return self._with(met.withColumns(new).select(*dict.fromkeys([*self.df.columns, *values])))

    def to_bag(self, *items: Column, within: LongRange | None = None, **columns: Column) -> BagFrame:
        """A bag of none, one or several rows for each element: arrays of structs, in ``items``, of which nulls are left out; or plain ``columns``."""
        from rangeloom.operators.bag import BagFrame

        df = self.df if within is None else self.df.where(within.where(self.idx))
        if columns:
            return BagFrame(df.select(*[v.alias(k) for k, v in columns.items()]))
        every = items[0] if len(items) == 1 else F.concat(*items)
        return BagFrame(df.select(F.explode(F.array_compact(every)).alias("__e")).select("__e.*"))

    def filter(self, condition: Column) -> DataFrame:
        return self.df.where(condition)

    # ---- reduce

    def reduce(self, **reductions: Column) -> DataFrame:
        return self.df.agg(*[c.alias(k) for k, c in reductions.items()])

    def reduce_with(self, reducer: Reducer, *columns: str) -> Any:
        return reduce_with(self.df, reducer, *columns)

    def zip_fold(self, other: IndexedFrame, within: LongRange | None = None, **reductions: Column) -> DataFrame:
        """Reductions over rows met by index, as a dot product."""
        return self.zipped(other, within=within).agg(*[c.alias(k) for k, c in reductions.items()])

    def size(self) -> int:
        return self.df.count()

    # ---- membership, equality

    def contains(self, name: str, value: Any) -> bool:
        """Whether an element's column has that value; null is a value too."""
        return not self.df.where(F.col(name).eqNullSafe(F.lit(value))).isEmpty()

    def contains_all(self, values: DataFrame, name: str) -> bool:
        """Whether each value of ``values``' first column is that of some element."""
        v = values.columns[0]
        missing = values.join(self.df.select(F.col(name).alias("__v")), F.col(v).eqNullSafe(F.col("__v")), "left_anti")
        return missing.isEmpty()

    def equals(self, other: IndexedFrame) -> bool:
        """Same indices, same values; null equals null."""
        a, b = self.df, other.df.withColumnRenamed(other.idx, self.idx)
        if set(a.columns) != set(b.columns):
            return False
        names = [c for c in a.columns if c != self.idx]
        right = b.select(F.col(self.idx).alias("__i"), *[F.col(c).alias(f"__r_{c}") for c in names])
        met = a.join(right, a[self.idx] == right["__i"], "full")
        same = a[self.idx].isNotNull() & F.col("__i").isNotNull()
        for c in names:
            same &= a[c].eqNullSafe(F.col(f"__r_{c}"))
        return met.where(~same).isEmpty()

    def content_hash(self) -> int:
        """A hash that depends on indices and values, not on how rows are stored."""
        row = self.df.agg(F.sum(F.xxhash64(*sorted(self.df.columns)).cast("decimal(38,0)"))).first()
        return int(row[0] or 0) % (1 << 64)

    # ---- products

    def product(self, inner: IndexedFrame) -> Product:
        from rangeloom.operators.product import Product

        return Product(self, inner)

    def combination(self) -> Product:
        """All pairs of two elements, the first with the smaller index."""
        from rangeloom.operators.product import Product

        return Product.triangle(self, self)

    # ---- storage

    def write(self, path: str) -> None:
        self.df.write.mode("overwrite").parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str, idx: str = "idx") -> IndexedFrame:
        return cls(spark.read.parquet(path), idx)

    def write_encoded(self, path: str, encode: Callable[[dict[str, Any]], bytes]) -> None:
        """Rows in a form of the caller's own: the index, and what ``encode`` makes of the row."""
        idx = self.idx

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = [encode(row) for row in batch.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(idx), pa.array(raw, pa.binary())], [idx, "raw"])

        self.df.mapInArrow(run, f"`{idx}` long, raw binary").write.mode("overwrite").parquet(path)

    @classmethod
    def read_encoded(cls, spark: SparkSession, path: str, decode: Callable[[bytes], dict[str, Any]], schema: str, idx: str = "idx") -> IndexedFrame:
        """What :meth:`write_encoded` wrote, by the function that undoes it; ``schema`` is that of the other columns."""
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import LongType, StructField, StructType

        out = StructType([StructField(idx, LongType()), *StructType.fromDDL(schema)])
        arrow = to_arrow_schema(out)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [{idx: i} | decode(raw) for i, raw in zip(batch.column(idx).to_pylist(), batch.column("raw").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        return cls(spark.read.parquet(path).mapInArrow(run, out), idx)


class RangesFilter:
    """A filter for a few ranges, pushed down to the scan; many are joined."""

    def __init__(self, ranges: Sequence[LongRange]):
        self.ranges = ranges

    def of(self, df: DataFrame, idx: str) -> DataFrame:
        if len(self.ranges) > 100:
            return range_join(df, RangeSet(self.ranges).frame(df.sparkSession), idx, "left_semi")
        found = F.lit(False)
        for r in self.ranges:
            found |= r.where(idx)
        return df.where(found)


def positions(df: DataFrame, idx: str, width: int = 1 << 16) -> DataFrame:
    """``df`` with ``__pos``, the number of rows with smaller indices, and ``__n``, the number of rows.

    Blocks of ``width`` indices are counted, the counts are summed up over blocks in two levels, and rows
    are numbered inside their block.
    """
    block = block_of(idx, width)
    counts = df.groupBy(block.alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    total = counts.agg(F.coalesce(F.sum("__c"), F.lit(0))).first()[0]
    starts = _sums_before(counts, "__c", 0).select("__b", F.col("__before").alias("__start"), F.lit(total).cast("long").alias("__n"))
    numbered = df.withColumn("__b", block).withColumn("__rn", F.row_number().over(Window.partitionBy("__b").orderBy(idx)))
    met = numbered.join(F.broadcast(starts) if small(starts) else starts, "__b")
    return met.withColumn("__pos", F.col("__start") + F.col("__rn") - 1).drop("__b", "__rn", "__start")


def prefix_sum(df: DataFrame, idx: str, value: Column, name: str = "prefix", width: int = 1 << 16) -> DataFrame:
    """``df`` with the sum of ``value`` over all indices up to the row's own, in two levels.

    Sums of blocks of ``width`` indices are scanned, in two levels again; rows are scanned inside their block.
    """
    keyed = df.withColumn("__b", block_of(idx, width)).withColumn("__v", value)
    sums = keyed.groupBy("__b").agg(F.sum("__v").alias("__s"))
    starts = _sums_before(sums, "__s", 0).select("__b", F.col("__before").alias("__start"))
    inside = Window.partitionBy("__b").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    scanned = keyed.withColumn("__in", F.sum("__v").over(inside))
    met = scanned.join(F.broadcast(starts) if small(starts) else starts, "__b")
    return met.withColumn(name, F.coalesce("__start", F.lit(0)) + F.coalesce("__in", F.lit(0))).drop("__b", "__v", "__in", "__start")


def _sums_before(blocks: DataFrame, value: str, zero: int) -> DataFrame:
    nothing = F.lit(zero)
    return scanned(blocks, "__b", value, F.sum, F.sum(value), lambda a, b: F.coalesce(a, nothing) + F.coalesce(b, nothing))


__all__ = ["IndexedFrame", "RangesFilter", "cut", "positions", "prefix_sum"]
