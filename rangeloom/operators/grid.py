"""Grids: rows (i, j, payload...), dense or sparse."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions.ranges import LongRange, SquareRange, part_of

if TYPE_CHECKING:
    from rangeloom.operators.indexed import IndexedFrame

#: The eight neighbours and the cell itself, as (di, dj).
AROUND = [(di, dj) for di in (-1, 0, 1) for dj in (-1, 0, 1)]


class GridFrame:
    """``df`` with at most one row for each (i, j); ``square`` is the domain if it is known."""

    def __init__(self, df: DataFrame, i: str = "i", j: str = "j", square: SquareRange | None = None):
        self.df, self.i, self.j, self.square = df, i, j, square

    def _with(self, df: DataFrame, square: SquareRange | None = None) -> GridFrame:
        return GridFrame(df, self.i, self.j, square or self.square)

    @classmethod
    def generate(cls, spark: SparkSession, square: SquareRange, **values: Column | Any) -> GridFrame:
        """Each cell of the square with expressions over i and j, or constants."""
        rows = square.frame(spark)
        return cls(rows.select("i", "j", *[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()]), square=square)

    @classmethod
    def from_values(cls, spark: SparkSession, square: SquareRange, values: Sequence[Any], name: str = "value", kind: str = "long") -> GridFrame:
        """Values in row order."""
        cells = [(i, j) for i in square.outer for j in square.columns(i)]
        if len(cells) != len(values):
            raise ValueError(f"{len(values)} values for {len(cells)} cells")
        return cls(spark.createDataFrame([(i, j, v) for (i, j), v in zip(cells, values, strict=True)], f"i long, j long, `{name}` {kind}"), square=square)

    def get(self, i: int, j: int) -> Row:
        row = self.df.where((F.col(self.i) == i) & (F.col(self.j) == j)).first()
        if row is None:
            raise IndexError((i, j))
        return row

    def set(self, i: int, j: int, **values: Any) -> GridFrame:
        if self.square is not None:
            self.square.check((i, j))
        at = (F.col(self.i) == i) & (F.col(self.j) == j)
        return self._with(self.df.withColumns({k: F.when(at, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(k)) for k, v in values.items()}))

    def contains(self, name: str, value: Any) -> bool:
        return not self.df.where(F.col(name).eqNullSafe(F.lit(value))).isEmpty()

    def view(self, square: SquareRange) -> GridFrame:
        """The part in a square, which must meet the grid."""
        common = square if self.square is None else self.square.intersection(square)
        if common is None:
            raise IndexError(str(square))
        return self._with(self.df.where(common.where(self.i, self.j)), common)

    def map(self, **values: Column) -> GridFrame:
        return self._with(self.df.select(self.i, self.j, *[v.alias(k) for k, v in values.items()]))

    def setup_from(self, source: GridFrame, **values: Column) -> GridFrame:
        """This grid with columns overwritten where ``source`` has the cell (its columns begin with ``r_``)."""
        right = source.df.select(F.col(source.i).alias("__i"), F.col(source.j).alias("__j"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"r_{c}") for c in source.df.columns if c not in (source.i, source.j)])
        met = self.df.join(right, (self.df[self.i] == right["__i"]) & (self.df[self.j] == right["__j"]), "left")
        new = {k: F.when(F.col("__hit"), v).otherwise(F.col(k)) if k in self.df.columns else F.when(F.col("__hit"), v) for k, v in values.items()}
        return self._with(met.withColumns(new).select(*dict.fromkeys([*self.df.columns, *values])))

    def update(self, within: SquareRange | None = None, **values: Column) -> GridFrame:
        new = values if within is None else {k: F.when(within.where(self.i, self.j), v).otherwise(F.col(k)) for k, v in values.items()}
        return self._with(self.df.withColumns(new))

    def for_each(self, action: Callable[[Iterable[Row]], None], within: SquareRange | None = None) -> None:
        (self.df if within is None else self.df.where(within.where(self.i, self.j))).foreachPartition(action)

    def reduce(self, **reductions: Column) -> DataFrame:
        return self.df.agg(*[c.alias(k) for k, c in reductions.items()])

    # ---- rows and columns

    def row(self, i: int) -> DataFrame:
        """(j, payload) of a row: a list by j."""
        return self.df.where(F.col(self.i) == i).drop(self.i)

    def column(self, j: int) -> DataFrame:
        return self.df.where(F.col(self.j) == j).drop(self.j)

    def row_list(self, i: int) -> IndexedFrame:
        """A row as a list by j; what is changed in it comes back into the grid by :meth:`with_row`."""
        from rangeloom.operators.indexed import IndexedFrame

        return IndexedFrame(self.row(i), self.j)

    def column_list(self, j: int) -> IndexedFrame:
        from rangeloom.operators.indexed import IndexedFrame

        return IndexedFrame(self.column(j), self.i)

    def with_row(self, i: int, row: IndexedFrame) -> GridFrame:
        """With a row's cells replaced by those of a list."""
        own = row.df.withColumnRenamed(row.idx, self.j).withColumn(self.i, F.lit(i).cast("long"))
        return self._with(self.df.where(F.col(self.i) != i).unionByName(own))

    def with_column(self, j: int, column: IndexedFrame) -> GridFrame:
        own = column.df.withColumnRenamed(column.idx, self.i).withColumn(self.j, F.lit(j).cast("long"))
        return self._with(self.df.where(F.col(self.j) != j).unionByName(own))

    def reduce_rows(self, within: LongRange | None = None, **reductions: Column) -> DataFrame:
        """Reductions of each row, its array never being built."""
        df = self.df if within is None else self.df.where(within.where(self.i))
        return df.groupBy(self.i).agg(*[c.alias(k) for k, c in reductions.items()])

    def reduce_columns(self, within: LongRange | None = None, **reductions: Column) -> DataFrame:
        df = self.df if within is None else self.df.where(within.where(self.j))
        return df.groupBy(self.j).agg(*[c.alias(k) for k, c in reductions.items()])

    def _lists(self, by: str, along: str, name: str, within: LongRange | None) -> DataFrame:
        df = self.df if within is None else self.df.where(within.where(by))
        pairs = F.array_sort(F.collect_list(F.struct(along, name)))
        return df.groupBy(by).agg(F.transform(pairs, lambda x: x[name]).alias("values"))

    def row_lists(self, name: str, within: LongRange | None = None) -> DataFrame:
        """(i, values): each row's values as an array in order of j, for rows that fit in one."""
        return self._lists(self.i, self.j, name, within)

    def column_lists(self, name: str, within: LongRange | None = None) -> DataFrame:
        return self._lists(self.j, self.i, name, within)

    # ---- neighbours

    def siblings(self, name: str, within: SquareRange | None = None, **reductions: Callable[[Column, Column, Column], Column]) -> DataFrame:
        """For each cell aggregates over itself and its neighbours: functions of (value, di, dj) that
        give aggregate columns. Cells outside of the grid don't exist.

        Each cell is sent to the nine it is near to, and met there: one shuffle, whatever the offsets.
        """
        offsets = F.array(*[F.struct(F.lit(a).cast("long").alias("di"), F.lit(b).cast("long").alias("dj")) for a, b in AROUND])
        sent = self.df.select(self.i, self.j, F.col(name).alias("__v"), F.explode(offsets).alias("o"))
        sent = sent.select((F.col(self.i) - F.col("o.di")).alias(self.i), (F.col(self.j) - F.col("o.dj")).alias(self.j), "__v", F.col("o.di").alias("__di"), F.col("o.dj").alias("__dj"))
        if within is not None:
            sent = sent.where(within.where(self.i, self.j))
        here = (F.col("__di") == 0) & (F.col("__dj") == 0)
        out = sent.groupBy(self.i, self.j).agg(F.bool_or(here).alias("__here"), *[f(F.col("__v"), F.col("__di"), F.col("__dj")).alias(k) for k, f in reductions.items()])
        return out.where("__here").drop("__here")

    # ---- tiles, copies

    def with_tile(self, outer: int, inner: int, square: SquareRange | None = None) -> DataFrame:
        """Rows with the numbers ti, tj of their tile among outer x inner near-equal ones."""
        s = square or self.square
        ti = part_of(F.col(self.i) - s.outer.start, s.outer.size, outer)
        tj = part_of(F.col(self.j) - s.inner.start, s.inner.size, inner)
        return self.df.withColumn("ti", ti).withColumn("tj", tj)

    def transpose(self) -> GridFrame:
        return GridFrame(self.df, self.j, self.i)

    def translate(self, di: int, dj: int) -> GridFrame:
        moved = self.df.withColumn(self.i, F.col(self.i) + di).withColumn(self.j, F.col(self.j) + dj)
        return GridFrame(moved, self.i, self.j, self.square and self.square.translate(di, dj))

    def equals(self, other: GridFrame) -> bool:
        names = sorted(self.df.columns)
        if names != sorted(other.df.columns):
            return False
        a, b = self.df.select(*names), other.df.select(*names)
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

    def iterate(self, within: SquareRange | None = None) -> Iterator[Row]:
        df = self.df if within is None else self.df.where(within.where(self.i, self.j))
        return df.orderBy(self.i, self.j).toLocalIterator()

    def to_list(self, within: SquareRange | None = None) -> list[Row]:
        return list(self.iterate(within))

    def size(self) -> int:
        return self.df.count()

    def write(self, path: str) -> None:
        self.df.write.mode("overwrite").parquet(path)


class TiledGrid(GridFrame):
    """A sparse grid of tiles that don't overlap."""

    def __init__(self, df: DataFrame, tiles: Sequence[SquareRange] = (), i: str = "i", j: str = "j"):
        super().__init__(df, i, j)
        self.tiles = list(tiles)

    def add(self, grid: GridFrame) -> TiledGrid:
        if any(grid.square.overlaps(t) for t in self.tiles):
            raise ValueError(f"{grid.square} overlaps")
        return TiledGrid(self.df.unionByName(grid.df), [*self.tiles, grid.square], self.i, self.j)

    def remove(self, tile: SquareRange) -> TiledGrid:
        self.tiles.index(tile)
        return TiledGrid(self.df.where(~tile.where(self.i, self.j)), [t for t in self.tiles if t != tile], self.i, self.j)

    def contains_tile(self, tile: SquareRange) -> bool:
        return tile in self.tiles

    def contains_index(self, i: int, j: int) -> bool:
        return any((i, j) in t for t in self.tiles)

    def ranges(self) -> list[SquareRange]:
        return list(self.tiles)

    def tile(self, t: SquareRange) -> GridFrame:
        self.tiles.index(t)
        return GridFrame(self.df.where(t.where(self.i, self.j)), self.i, self.j, t)
