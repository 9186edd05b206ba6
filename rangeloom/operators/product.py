"""Products of two lists: all pairs, or the upper triangle of them, in tiles.

The pairs of a tile of work meet by an equi-join on it: rows of the outer list go to each tile of their
row of tiles, rows of the inner list to each of their column. Its size is fixed, whatever tiles are asked
for, so a task has as many pairs over large lists as over small ones, and no side is broadcast or gathered
as a whole. Which tiles a row goes to is arithmetic over its own tile: there is no list of tiles, and tiles
without a pair are never made.

Reductions that don't need the pairs don't make them: sums over pairs of a value of the outer row times one
of the inner row (:func:`times`, :data:`EACH`) come from sums of both lists and a scan along the diagonal, and
counts, sums, minima and maxima over each row's partners from one scan. Their work grows with the lists.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from operator import add
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from rangeloom.functions.ranges import LongRange, SquareRange, part_of, part_start
from rangeloom.operators.interval import RUNS, running
from rangeloom.operators.local import local_batches

if TYPE_CHECKING:
    import pyarrow as pa

    from rangeloom.operators.grid import GridFrame
    from rangeloom.operators.indexed import IndexedFrame

#: Indices of the side of a tile of work, and tiles of a side at most; a row is sent to as many tiles as the other side has.
TILE, MOST_TILES = 2048, 1024
#: Partitions that tiles of work are dealt to at most.
MOST_PARTS = 4096
#: Sides of the tiles that functions over two blocks get: an eighth of the list's, in these bounds.
LEAST_BLOCK, MOST_BLOCK = 512, 8192


def _tiles(size: int, side: int = TILE) -> int:
    return max(1, min(-(-size // side), MOST_TILES))


class PairSum:
    """A sum over pairs of products of an integer of the outer row and one of the inner row; ``+`` adds terms."""

    def __init__(self, *terms: tuple[Column, Column]):
        self.terms = terms

    def __add__(self, other: PairSum) -> PairSum:
        return PairSum(*self.terms, *other.terms)


def times(outer: Column, inner: Column) -> PairSum:
    """The sum over pairs of ``outer`` (over i, l_...) times ``inner`` (over j, r_...). Pairs where one is null are left out."""
    return PairSum((outer, inner))


#: One for each pair: their number.
EACH = PairSum()


class Product:
    """Pairs (i, j) of ``square`` with the outer row's columns as ``l_...`` and the inner row's as ``r_...``."""

    def __init__(self, outer: IndexedFrame, inner: IndexedFrame, square: SquareRange | None = None, tiles: tuple[int, int] | None = None):
        self.outer, self.inner = outer, inner
        self.square = square or SquareRange(_span(outer), _span(inner))
        self.tiles = tiles or (_tiles(self.square.outer.size), _tiles(self.square.inner.size))

    @classmethod
    def triangle(cls, outer: IndexedFrame, inner: IndexedFrame, shift: int = 0) -> Product:
        """Pairs with ``j >= i + 1 - shift``."""
        return cls(outer, inner, SquareRange(_span(outer), _span(inner), True, shift))

    def split(self, outer: int, inner: int) -> Product:
        """The same pairs, in outer x inner tiles."""
        return Product(self.outer, self.inner, self.square, (outer, inner))

    def split_ranges(self) -> list[SquareRange]:
        return self.square.split(*self.tiles)

    def sub_view(self, square: SquareRange) -> Product:
        common = self.square.intersection(square)
        if common is None:
            raise IndexError(str(square))
        return Product(self.outer, self.inner, common)

    def views(self, squares: list[SquareRange]) -> list[Product]:
        return [self.sub_view(s) for s in squares]

    def _sides(self) -> tuple[DataFrame, DataFrame]:
        s = self.square
        left = self.outer.df.where(s.outer.where(self.outer.idx))
        right = self.inner.df.where(s.inner.where(self.inner.idx))
        left = left.select(F.col(self.outer.idx).alias("i"), *[F.col(c).alias(f"l_{c}") for c in left.columns if c != self.outer.idx])
        right = right.select(F.col(self.inner.idx).alias("j"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c != self.inner.idx])
        return left, right

    def pairs(self) -> DataFrame:
        """(i, j, l_..., r_..., ti, tj), the last two being the tile."""
        s = self.square
        left, right = self._met(TILE, TILE)
        met = left.join(right, ["wi", "wj"])
        rest = [c for c in met.columns if c not in ("i", "j", "ti", "tj", "wi", "wj")]
        return (met.where(s.where("i", "j")) if s.triangle else met).select("i", "j", *rest, "ti", "tj")

    def _met(self, outer: int, inner: int) -> tuple[DataFrame, DataFrame]:
        """Both sides with their tiles, each row once for each tile of work (wi, wj), of sides ``outer`` x ``inner``, and dealt by it."""
        s = self.square
        work = (_tiles(s.outer.size, outer), _tiles(s.inner.size, inner))
        parts = min(work[0] * work[1] if not s.triangle else work[0] * work[1] // 2 + max(work), MOST_PARTS)
        left, right = self._tiled()
        left = left.withColumn("wi", part_of(F.col("i") - s.outer.start, s.outer.size, work[0])).withColumn("wj", F.explode(self._tiles_of_row(work)))
        right = right.withColumn("wj", part_of(F.col("j") - s.inner.start, s.inner.size, work[1])).withColumn("wi", F.explode(self._tiles_of_column(work)))
        return left.repartition(parts, "wi", "wj"), right.repartition(parts, "wi", "wj")

    def _tiled(self) -> tuple[DataFrame, DataFrame]:
        s, (left, right) = self.square, self._sides()
        left = left.withColumn("ti", part_of(F.col("i") - s.outer.start, s.outer.size, self.tiles[0]))
        return left, right.withColumn("tj", part_of(F.col("j") - s.inner.start, s.inner.size, self.tiles[1]))

    def _tiles_of_row(self, work: tuple[int, int]) -> Column:
        """The tiles of work that the row of tiles ``wi`` has pairs in: from the one that its first index begins with."""
        s, parts = self.square, work[1]
        if not s.triangle:
            return F.sequence(F.lit(0), F.lit(parts - 1))
        first = part_start(F.col("wi"), s.outer.size, work[0]) + (s.outer.start + 1 - s.shift - s.inner.start)
        low = part_of(F.greatest(first, F.lit(0).cast("long")), s.inner.size, parts)
        return F.when(first < s.inner.size, F.sequence(low, F.lit(parts - 1))).otherwise(F.array().cast("array<int>"))

    def _tiles_of_column(self, work: tuple[int, int]) -> Column:
        """The tiles of work that the column of tiles ``wj`` has pairs in: up to the one that its last index ends with."""
        s, parts = self.square, work[0]
        if not s.triangle:
            return F.sequence(F.lit(0), F.lit(parts - 1))
        last = part_start(F.col("wj") + 1, s.inner.size, work[1]) + (s.inner.start - 2 + s.shift - s.outer.start)
        high = part_of(F.least(last, F.lit(s.outer.size - 1).cast("long")), s.outer.size, parts)
        return F.when(last >= 0, F.sequence(F.lit(0), high)).otherwise(F.array().cast("array<int>"))

    # ---- reductions without pairs

    def _tile_sums(self, **sums: PairSum) -> DataFrame:
        """(ti, tj, sums, __pairs) of the tiles that have pairs.

        An outer row has all of the columns of tiles after the one in which its pairs begin, and of that one what is
        left of the inner list from there on (a scan) without what is in the columns after it.
        """
        s, (a, b) = self.square, self.tiles
        left, right = self._tiled()
        one, exact = F.lit(1).cast("decimal(20,0)"), lambda c: F.coalesce(c.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
        there = lambda c: F.when(c.isNotNull(), one).otherwise(F.lit(0).cast("decimal(20,0)"))
        forms, of = [(one, one)], {}
        for name, total in sums.items():
            of[name] = range(len(forms), len(forms) + 2 * len(total.terms), 2)
            for f, g in total.terms:
                forms += [(exact(f), exact(g)), (there(f), there(g))]
        ks, none = range(len(forms)), F.lit(0).cast("decimal(38,0)")
        if s.triangle:
            keys, rows = left.withColumn("key", s.shift - 1 - F.col("i")), right.withColumn("key", -F.col("j"))
            span = (min(s.shift - s.outer.stop, 1 - s.inner.stop), max(s.shift - 1 - s.outer.start, -s.inner.start))
            stairs = running(keys, rows, {f"g{k}": ("sum", forms[k][1]) for k in ks}, {f"f{k}": ("sum", forms[k][0]) for k in ks}, span=span)
            begin = -F.col("key") - s.inner.start
            p = F.when(begin < 0, F.lit(-1)).when(begin < s.inner.size, part_of(begin, s.inner.size, b))
            stairs = stairs.withColumn("ti", part_of(s.shift - 1 - F.col("key") - s.outer.start, s.outer.size, a)).withColumn("p", p).where("p IS NOT NULL")
            stairs = stairs.groupBy("ti", "p").agg(*[F.sum(F.coalesce(F.col(f"f{k}") * F.col(f"g{k}"), none)).alias(f"a{k}") for k in ks], *[F.sum(f"f{k}").alias(f"f{k}") for k in ks])
        else:
            stairs = left.groupBy("ti").agg(F.lit(-1).alias("p"), *[none.alias(f"a{k}") for k in ks], *[F.sum(forms[k][0]).alias(f"f{k}") for k in ks])
        later = Window.orderBy(F.desc("tj")).rowsBetween(Window.unboundedPreceding, -1)
        columns = right.groupBy("tj").agg(*[F.sum(forms[k][1]).alias(f"c{k}") for k in ks])
        # Each column of tiles, an empty one too.
        columns = columns.unionByName(columns.sparkSession.range(b).select(F.col("id").cast("int").alias("tj")), allowMissingColumns=True).groupBy("tj").agg(*[F.coalesce(F.sum(f"c{k}"), none).alias(f"c{k}") for k in ks])
        columns = columns.select("*", *[F.coalesce(F.sum(f"c{k}").over(later), none).alias(f"z{k}") for k in ks])
        met = stairs.join(F.broadcast(columns), F.col("tj") >= F.col("p"))
        part = lambda k: F.when(F.col("tj") == F.col("p"), F.col(f"a{k}") - F.col(f"f{k}") * F.col(f"z{k}")).otherwise(F.col(f"f{k}") * F.col(f"c{k}"))
        tiles = met.groupBy("ti", "tj").agg(*[F.sum(part(k)).alias(f"s{k}") for k in ks]).where("s0 > 0")
        made = {name: F.when(reduce(add, [F.col(f"s{k + 1}") for k in own]) > 0, reduce(add, [F.col(f"s{k}") for k in own])) if own else F.col("s0") for name, own in of.items()}
        return tiles.select("ti", "tj", *[c.alias(name) for name, c in made.items()])

    def sums(self, **sums: PairSum) -> DataFrame:
        """One row: :func:`times` and :data:`EACH` over all pairs, as longs. Of no pairs the number is 0, sums are null."""
        return _added(Product(self.outer, self.inner, self.square, (1, 1))._tile_sums(**sums), sums)

    def sum_tiles(self, **sums: PairSum) -> DataFrame:
        """(ti, tj, sums) of each tile that has pairs."""
        return _added(self._tile_sums(**sums), sums, "ti", "tj")

    def sum_dealt(self, parts: int, how: str = "random", seed: int = 0, **sums: PairSum) -> DataFrame:
        """(part, sums) of the parts that tiles are dealt to, see :meth:`dealt`."""
        return _added(self._tile_sums(**sums).withColumn("part", self._part(parts, how, seed)), sums, "part")

    def scan_outer(self, within: LongRange | None = None, **values: tuple[str, Column]) -> DataFrame:
        """(i, values): as :meth:`reduce_outer`, for (count, sum, min or max, column of the inner row)."""
        p = self if within is None else self.sub_view(replace(self.square, outer=within))
        (left, right), s = p._sides(), p.square
        span = (min(s.shift - s.outer.stop, 1 - s.inner.stop), max(s.shift - 1 - s.outer.start, -s.inner.start))
        return _partners(left.withColumn("key", s.shift - 1 - F.col("i")), right.withColumn("key", -F.col("j")), "i", s.shift - 1 - F.col("key"), values, s.triangle, span)

    def scan_inner(self, within: LongRange | None = None, **values: tuple[str, Column]) -> DataFrame:
        """(j, values): as :meth:`reduce_inner`, for (count, sum, min or max, column of the outer row)."""
        p = self if within is None else self.sub_view(replace(self.square, inner=within))
        (left, right), s = p._sides(), p.square
        span = (min(s.outer.start, s.inner.start - 1 + s.shift), max(s.outer.stop - 1, s.inner.stop - 2 + s.shift))
        return _partners(right.withColumn("key", F.col("j") - 1 + s.shift), left.withColumn("key", F.col("i")), "j", F.col("key") + 1 - s.shift, values, s.triangle, span)

    def scatter_sums(self, outer: Column | None = None, inner: Column | None = None) -> DataFrame:
        """(idx, delta): as :meth:`scatter` of ``(i, outer)`` and ``(j, inner)``, where ``outer`` is over the inner row's
        columns and ``inner`` over the outer row's."""
        sent = [] if outer is None else [self.scan_outer(delta=("sum", outer)).withColumnRenamed("i", "idx")]
        sent += [] if inner is None else [self.scan_inner(delta=("sum", inner)).withColumnRenamed("j", "idx")]
        kind = sent[0].schema["delta"].dataType
        return reduce(DataFrame.unionByName, sent).groupBy("idx").agg(F.sum("delta").cast(kind).alias("delta"))

    def map_blocks(self, function: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """A function over the rows of both sides (i, l_..., ti and j, r_..., tj) of each tile of work, as Arrow tables;
        in a triangle it also gets pairs that the square hasn't."""
        sides = [min(max(-(-r.size // 8), LEAST_BLOCK), MOST_BLOCK) for r in (self.square.outer, self.square.inner)]
        left, right = self._met(*sides)
        return left.groupBy("wi", "wj").cogroup(right.groupBy("wi", "wj")).applyInArrow(lambda a, b: function(a, b), schema)

    def get(self, i: int, j: int) -> Row:
        """The pair (outer row i, inner row j)."""
        self.square.check((i, j))
        left, right = self._sides()
        return left.where(F.col("i") == i).join(right.where(F.col("j") == j), F.lit(True)).first()

    def map(self, **values: Column) -> DataFrame:
        return self.pairs().select("i", "j", *[v.alias(k) for k, v in values.items()])

    def map_batches(self, function: Callable, schema: str, make: Callable[[], Any] | None = None) -> DataFrame:
        """A function over Arrow batches of pairs; with ``make`` it also gets an object that each task makes for itself."""
        return local_batches(self.pairs(), function, schema, make)

    def reduce(self, **reductions: Column) -> DataFrame:
        return self.pairs().agg(*[c.alias(k) for k, c in reductions.items()])

    def reduce_outer(self, within: LongRange | None = None, **reductions: Column) -> DataFrame:
        """Aggregates over each outer row's partners; rows of ``within`` only, if given."""
        p = self if within is None else self.sub_view(replace(self.square, outer=within))
        return p.pairs().groupBy("i").agg(*[c.alias(k) for k, c in reductions.items()])

    def reduce_inner(self, within: LongRange | None = None, **reductions: Column) -> DataFrame:
        p = self if within is None else self.sub_view(replace(self.square, inner=within))
        return p.pairs().groupBy("j").agg(*[c.alias(k) for k, c in reductions.items()])

    def reduce_tiles(self, **reductions: Column) -> DataFrame:
        """Aggregates of each tile."""
        return self.pairs().groupBy("ti", "tj").agg(*[c.alias(k) for k, c in reductions.items()])

    def inner_pairs(self, i: int) -> DataFrame:
        """The inner rows that go with outer index ``i``."""
        return self.inner.df.where(self.square.columns(i).where(self.inner.idx))

    def outer_pairs(self, j: int) -> DataFrame:
        return self.outer.df.where(self.square.rows(j).where(self.outer.idx))

    def dealt(self, parts: int, how: str = "random", seed: int = 0) -> DataFrame:
        """Pairs with the ``part`` their tile is dealt to: in blocks, in turn or by a seeded hash. Which
        part a pair is in never changes what all parts give together."""
        return self.pairs().withColumn("part", self._part(parts, how, seed))

    def _part(self, parts: int, how: str, seed: int) -> Column:
        n = self.tiles[0] * self.tiles[1]
        number = F.col("ti") * self.tiles[1] + F.col("tj")
        return {"block": part_of(number, n, parts), "cyclic": F.pmod(number, F.lit(parts)), "random": F.pmod(F.xxhash64(F.lit(seed), "ti", "tj"), F.lit(parts)).cast("int")}[how]

    def scatter(self, *deltas: tuple[Column, Column], **aggregates: Callable[[Column], Column]) -> DataFrame:
        """Sends to index ``deltas[k][0]`` the value ``deltas[k][1]`` for each pair and aggregates what each index gets."""
        from rangeloom.operators.accumulate import scatter

        return scatter(self.pairs(), *deltas, **aggregates)

    def siblings(self, value: Column, within: SquareRange | None = None, **reductions: Callable[[Column, Column, Column], Column]) -> DataFrame:
        return self.to_grid(value=value).siblings("value", within, **reductions)

    def sibling_sums(self, name: str, outer: Column, inner: Column) -> DataFrame:
        """(i, j, name): for each cell the sum of ``outer`` times ``inner`` over itself and its neighbours, of a product of all pairs.

        It is the sum of ``outer`` over the row and the ones beside it times that of ``inner``: no cell is sent to another.
        """
        if self.square.triangle:
            raise ValueError("neighbours in a triangle aren't a product: use siblings")
        left, right = self._sides()
        a, b = _around(left, "i", outer), _around(right, "j", inner)
        met = Product(a, b, self.square).pairs()
        return met.select("i", "j", F.when((F.col("l_n") > 0) & (F.col("r_n") > 0), F.col("l_v") * F.col("r_v")).alias(name))

    def to_grid(self, **values: Column) -> GridFrame:
        from rangeloom.operators.grid import GridFrame

        return GridFrame(self.map(**values), square=self.square)

    def size(self) -> int:
        """The number of pairs that exist."""
        return self.pairs().count()


def _added(tiles: DataFrame, sums: dict[str, PairSum], *by: str) -> DataFrame:
    each = {name: F.sum(name) if total.terms else F.coalesce(F.sum(name), F.lit(0)) for name, total in sums.items()}
    return tiles.groupBy(*by).agg(*[c.cast("long").alias(name) for name, c in each.items()])


def _partners(keys: DataFrame, rows: DataFrame, name: str, idx: Column, values: dict[str, tuple[str, Column]], triangle: bool, span: tuple[int, int]) -> DataFrame:
    """(name, values) over the rows at or below each key, or all rows; keys with none are left out."""
    one = F.lit(1).cast("long")
    sent = {k: ("sum", F.when(v.isNotNull(), one).otherwise(F.lit(0).cast("long"))) if op == "count" else (op, v) for k, (op, v) in values.items()}
    sent, own = sent | {"__met": ("sum", one)}, {"__copies": ("sum", one)}
    if triangle:
        found = running(keys, rows, sent, own, span=span)
    else:
        found = keys.groupBy("key").agg(F.sum(one).alias("__copies")).crossJoin(F.broadcast(rows.agg(*[RUNS[op][0](v).alias(k) for k, (op, v) in sent.items()])))
    kinds = dict(found.dtypes)
    made = {k: (F.col(k) * F.col("__copies")).cast(kinds[k]) if op in ("count", "sum") else F.col(k) for k, (op, _) in values.items()}
    return found.where("__met > 0").select(idx.alias(name), *[c.alias(k) for k, c in made.items()])


def _around(side: DataFrame, idx: str, value: Column) -> IndexedFrame:
    """``v``, the sum of ``value`` over each index of a list and the ones beside it, and ``n``, the number of values."""
    from rangeloom.operators.indexed import IndexedFrame

    sent = side.select(F.col(idx).alias("at"), value.cast("long").alias("v"), F.explode(F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])).alias("d"))
    near = sent.groupBy((F.col("at") - F.col("d")).alias("idx")).agg(F.sum("v").alias("v"), F.count("v").alias("n"), F.bool_or(F.col("d") == 0).alias("here"))
    return IndexedFrame(near.where("here").drop("here"), "idx")


def _span(x: IndexedFrame) -> LongRange:
    """From the first index to the last."""
    if x._ranges:
        return LongRange(min(r.start for r in x._ranges), max(r.stop for r in x._ranges))
    row = x.df.agg(F.min(x.idx), F.max(x.idx)).first()
    return LongRange(row[0], row[1] + 1) if row[0] is not None else LongRange(0, 0)
