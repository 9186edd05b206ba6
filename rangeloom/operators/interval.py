"""Joins of indices with ranges, by block: equi-joins instead of comparing each index with each range."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.functions.ranges import block_of, quotient

#: A side of at most so many rows, as a count shows, may be broadcast.
SMALL = 20_000


def small(df: DataFrame, most: int = SMALL) -> bool:
    return df.limit(most + 1).count() <= most


#: Stretches into which the span of blocks is cut for a scan in two levels.
STRETCHES = 4096


def scanned(line: DataFrame, block: str, value: str, over: Callable[[str], Column], whole: Column, both: Callable[[Column, Column], Column]) -> DataFrame:
    """``line`` (a row a block) with ``__before``: what ``value`` comes to over all blocks before a row's own.

    ``over`` is the running aggregate, ``whole`` the aggregate of a stretch of blocks, ``both`` puts what is before a
    stretch together with what is before a row in it. Stretches are scanned first, ``STRETCHES`` rows at most, then
    blocks inside their stretch.
    """
    low, high = line.agg(F.min(block), F.max(block)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // STRETCHES))
    cut = line.withColumn("__stretch", quotient(F.col(block) - F.lit(low or 0), width))
    tops = cut.groupBy("__stretch").agg(whole.alias("__whole"))
    order = Window.orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("__stretch", over("__whole").over(order).alias("__top"))
    inside = Window.partitionBy("__stretch").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    met = cut.withColumn("__in", over(value).over(inside)).join(F.broadcast(tops), "__stretch")
    return met.withColumn("__before", both(F.col("__top"), F.col("__in"))).drop("__stretch", "__in", "__top")


#: Keys of a block of a running scan; aggregates that can be taken of their own results, and how two of those go together.
RUN = 8192
RUNS = {"sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def running(keys: DataFrame, rows: DataFrame, values: dict[str, tuple[str, Column]], own: dict[str, tuple[str, Column]] | None = None, key: str = "key", span: tuple[int, int] | None = None, width: int = RUN) -> DataFrame:
    """(key, own, values): each different key of ``keys`` with ``own``, aggregated over its rows, and ``values``,
    aggregated over all ``rows`` whose key is at or below it. Aggregates are (sum, min or max, column).

    Equal keys are one row before they are sorted, keys are scanned inside blocks of ``width``, and blocks in two
    levels, stretches of blocks first: the work grows with keys and rows, not with the pairs of them.
    """
    own = own or {}
    kinds = dict(rows.agg(*[RUNS[op][0](v).alias(k) for k, (op, v) in values.items()]).dtypes)
    first = rows.select(F.col(key).cast("long").alias("__key"), F.lit(False).alias("__ask"), *[v.alias(k) for k, (_, v) in values.items()])
    asked = keys.select(F.col(key).cast("long").alias("__key"), F.lit(True).alias("__ask"), *[v.alias(k) for k, (_, v) in own.items()])
    both = first.unionByName(asked, allowMissingColumns=True).where("__key IS NOT NULL")
    if span is None:
        span = tuple(both.agg(F.min("__key"), F.max("__key")).first())
    low, high = ((span[0] or 0) // width, (span[1] or 0) // width)
    stretch = max(1, -(-(high - low + 1) // STRETCHES))
    block, before = block_of("__key", width).alias("__block"), Window.unboundedPreceding
    # What is before each block: one row a block, STRETCHES stretches at most.
    line = first.where("__key IS NOT NULL").groupBy(block).agg(*[RUNS[op][0](k).alias(k) for k, (op, _) in values.items()])
    line = line.unionByName(asked.where("__key IS NOT NULL").select(block).distinct(), allowMissingColumns=True)
    line = line.groupBy("__block").agg(*[RUNS[op][0](k).alias(k) for k, (op, _) in values.items()]).withColumn("__stretch", quotient(F.col("__block") - F.lit(low), stretch))
    tops = line.groupBy("__stretch").agg(*[RUNS[op][0](k).alias(k) for k, (op, _) in values.items()])
    order = Window.orderBy("__stretch").rowsBetween(before, -1)
    tops = tops.select("__stretch", *[RUNS[op][0](k).over(order).alias(f"__top_{k}") for k, (op, _) in values.items()])
    inside = Window.partitionBy("__stretch").orderBy("__block").rowsBetween(before, -1)
    line = line.select("__block", "__stretch", *[RUNS[op][0](k).over(inside).alias(f"__in_{k}") for k, (op, _) in values.items()]).join(F.broadcast(tops), "__stretch")
    line = line.select("__block", *[RUNS[op][1](F.col(f"__top_{k}"), F.col(f"__in_{k}")).alias(f"__before_{k}") for k, (op, _) in values.items()])
    # Keys inside their block.
    each = both.groupBy("__key").agg(F.bool_or("__ask").alias("__ask"), *[RUNS[op][0](k).alias(k) for k, (op, _) in (values | own).items()])
    here = Window.partitionBy("__block").orderBy("__key").rowsBetween(before, 0)
    each = each.withColumn("__block", block).withColumns({k: RUNS[op][0](k).over(here) for k, (op, _) in values.items()}).where("__ask")
    met = each.join(F.broadcast(line) if high - low < SMALL else line, "__block")
    return met.select(F.col("__key").alias(key), *own, *[RUNS[op][1](F.col(f"__before_{k}"), F.col(k)).cast(kinds[k]).alias(k) for k, (op, _) in values.items()])


def covered(rows: DataFrame, ranges: DataFrame, idx: str = "idx", n: str = "n", last: str = "last") -> DataFrame:
    """Each index of ``rows`` that lies in some of ``ranges`` (start, stop) with their number and their greatest stop.

    What :func:`range_join` and a count for each index give, but by one scan over starts and stops: the number is
    the ranges begun less those ended at an index, and the greatest stop of those begun is one of a range that holds it.
    """
    real = ranges.where("start < stop").select(F.col("start").cast("long").alias("start"), "stop")
    one = F.lit(1).cast("long")
    begun = real.select(F.col("start").alias("key"), one.alias("d"), F.col("stop").alias("s"))
    ended = real.select(F.col("stop").cast("long").alias("key"), (-one).alias("d"))
    found = running(rows.select(F.col(idx).alias("key")), begun.unionByName(ended, allowMissingColumns=True), {"d": ("sum", F.col("d")), "s": ("max", F.col("s"))}, {"copies": ("sum", one)})
    return found.where("d > 0").select(F.col("key").cast(rows.schema[idx].dataType).alias(idx), (F.col("d") * F.col("copies")).alias(n), F.col("s").alias(last))


def blocks(ranges: DataFrame, width: int) -> DataFrame:
    """Each range once for each block of ``width`` indices that it meets."""
    return ranges.where("start < stop").withColumn("block", F.explode(F.sequence(block_of("start", width), block_of(F.col("stop") - 1, width))))


#: Ranges whose lengths are between powers of this are a class, which has blocks of a width of its own.
CLASS = 8


def length_classes(ranges: DataFrame) -> list[int]:
    """The block widths of the classes that ``ranges`` have: at most 21, whatever the ranges."""
    size = (F.col("stop") - F.col("start")).cast("double")
    k = F.ceil(F.log(float(CLASS), size) - 1e-9)
    found = ranges.where("start < stop").select(F.greatest(k, F.lit(0)).cast("int").alias("k")).distinct().collect()
    return sorted(CLASS**r.k for r in found)


def _of_class(ranges: DataFrame, width: int) -> DataFrame:
    size = F.col("stop") - F.col("start")
    return ranges.where((size <= width) & (size > (width // CLASS if width > 1 else 0)))


def range_join(rows: DataFrame, ranges: DataFrame, idx: str = "idx", how: str = "inner", width: int | None = None) -> DataFrame:
    """Each row with each range (start, stop, ...) that holds its index; ``how``: inner, left, left_semi or left_anti.

    Ranges are met by block, an equi-join. The blocks of a class of lengths are as wide as its longest ranges, so
    a range lies in two of them at most, and a few long ranges don't widen the blocks of many short ones.
    ``width`` gives one width for all instead.
    """
    widths = [width] if width else length_classes(ranges) or [1]
    parts = [(w, ranges if width else _of_class(ranges, w)) for w in widths]
    if how == "left_anti":
        for w, own in parts:
            rows = _met(rows, own, idx, how, w)
        return rows
    if how == "left_semi" and len(parts) > 1:
        found = _union([_met(rows.select(idx).distinct(), own, idx, how, w) for w, own in parts]).distinct()
        return rows.join(found.withColumnRenamed(idx, "__found"), F.col(idx) == F.col("__found"), "left_semi")
    if how == "left" and len(parts) > 1:
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in ranges.schema]
        return _union([_met(rows, own, idx, "inner", w) for w, own in parts] + [range_join(rows, ranges, idx, "left_anti").select("*", *missing)])
    return _union([_met(rows, own, idx, how, w) for w, own in parts])


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _met(rows: DataFrame, ranges: DataFrame, idx: str, how: str, width: int) -> DataFrame:
    right = blocks(ranges, width)
    if small(ranges):
        right = F.broadcast(right)
    left = rows.withColumn("__block", block_of(idx, width))
    right = right.withColumnRenamed("block", "__right")
    on = (F.col("__block") == F.col("__right")) & (left[idx] >= right["start"]) & (left[idx] < right["stop"])
    return left.join(right, on, how).drop("__block", "__right")


def floor_join(rows: DataFrame, marks: DataFrame, idx: str = "idx", mark: str = "start", width: int | None = None) -> DataFrame:
    """Each row with ``marks``' row of the greatest ``mark`` at or below its index (columns null if none).

    Rows and marks are dealt by block of ``width`` indices; the last mark before each block is
    carried into it by a scan over blocks in two levels (:func:`scanned`), so no task sees all blocks.
    """
    rest = [c for c in marks.columns if c != mark]
    if width is None:
        row = marks.agg(F.min(mark), F.max(mark), F.count(F.lit(1))).first()
        width = max(1, ((row[1] or 0) - (row[0] or 0) + 1) * 64 // max(row[2], 1))
    payload = F.struct(F.col(mark).alias("__at"), *rest)
    marked = marks.select(block_of(mark, width).alias("__block"), F.col(mark).alias("__key"), payload.alias("__mark"))
    keyed = rows.withColumn("__block", block_of(idx, width))
    # What each block of rows starts with: the last mark of the latest block before it. One row a block.
    lasts = marked.groupBy("__block").agg(F.max_by("__mark", "__key").alias("__mark"))
    wanted = keyed.select("__block").distinct()
    line = lasts.select("__block", "__mark").unionByName(wanted.select("__block", F.lit(None).alias("__mark")), allowMissingColumns=True)
    line = line.groupBy("__block").agg(F.max("__mark").alias("__mark"))
    last = lambda c: F.last(c, ignorenulls=True)
    carried = scanned(line, "__block", "__mark", last, F.max_by("__mark", F.when(F.col("__mark").isNotNull(), F.col("__block"))), lambda a, b: F.coalesce(b, a))
    carried = carried.select("__block", F.col("__before").alias("__carried"))
    names = [F.col(f"`{c}`") for c in rows.columns]
    both = keyed.select("__block", F.col(idx).alias("__key"), F.struct(*names).alias("__row"), F.lit(None).alias("__mark")).unionByName(
        marked.select("__block", "__key", F.lit(None).alias("__row"), "__mark"), allowMissingColumns=True
    )
    inside = Window.partitionBy("__block").orderBy("__key", F.col("__row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__m", F.last("__mark", ignorenulls=True).over(inside)).where("__row IS NOT NULL")
    found = found.join(carried, "__block", "left").withColumn("__m", F.coalesce("__m", "__carried"))
    return found.select("__row.*", F.col("__m.__at").alias(mark), *[F.col(f"__m.{c}").alias(c) for c in rest])
