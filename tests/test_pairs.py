"""Reductions over pairs, folds and covers whose work grows with the lists, against all pairs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from rangeloom import IndexedFrame, LongRange, Product, SquareRange
from rangeloom.operators.product import EACH, times


@pytest.fixture(autouse=True)
def interpreted(spark):
    """Many small plans: compiling them takes longer than running them."""
    names = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def some_list(spark, rng, low=-30, high=30, n=25):
    """Indices with gaps, some twice, and values that may be null."""
    rows = [(rng.randrange(low, high), rng.choice([None, *range(-5, 6)])) for _ in range(n)]
    return IndexedFrame(spark.createDataFrame(rows, "idx long, v int"), "idx")


def some_products(spark):
    rng = random.Random(11)
    for _ in range(2):
        x, y = some_list(spark, rng), some_list(spark, rng)
        yield Product.triangle(x, y, rng.randrange(-12, 12)).split(rng.randrange(1, 6), rng.randrange(1, 6))
    yield some_list(spark, rng).product(some_list(spark, rng)).split(3, 2)
    yield Product(x, y, SquareRange(LongRange(-10, 12), LongRange(-8, 5), True, 3)).split(2, 4)
    yield Product.triangle(x, y, -100).split(2, 2)


def same(a, b):
    return sorted(map(tuple, a.select(sorted(a.columns)).collect()), key=str) == sorted(map(tuple, b.select(sorted(b.columns)).collect()), key=str)


def test_dot_bounds(spark):
    """By SQL's rules for missing and odd elements, in blocks and tiles of any size."""
    import numpy as np

    from rangeloom.operators import dots

    rng = np.random.default_rng(3)
    vectors = [[float(np.float32(a)) for a in rng.normal(size=5)] for _ in range(40)]
    vectors[3], vectors[9], vectors[10], vectors[11] = None, [1.0, None, 2.0, None, 1.0], [], [None] * 5
    vectors[20], vectors[21], vectors[22] = [0.5, 0.25], vectors[23], vectors[23]
    x = IndexedFrame(spark.createDataFrame(list(enumerate(vectors)), "idx long, e array<float>"), "idx")

    def dot(a, b):
        met = [p * q for p, q in zip(a or [], b or [], strict=False) if p is not None and q is not None]
        total = 0.0
        for m in met:
            total += m
        return total if met else None

    for shift, tiles, step, many in ((0, (2, 3), 512, 10_000), (0, (4, 4), 7, 0), (3, (1, 1), 16, 0), (None, (3, 2), 5, 10_000)):
        p = (x.product(x) if shift is None else Product.triangle(x, x, shift)).split(*tiles)
        tile = [[k for k, r in enumerate(LongRange(0, 40).split(n)) for _ in r] for n in tiles]
        want = {}
        for i in range(40):
            for j in range(40):
                if shift is None or j >= i + 1 - shift:
                    want.setdefault((tile[0][i], tile[1][j]), []).append(dot(vectors[i], vectors[j]))
        dots.STEP, dots.MANY, before = step, max(many, 1), (dots.STEP, dots.MANY)
        try:
            for part in (slice(0, 40), slice(5, 31)):
                left = x.df.where(F.col("idx").between(part.start, part.stop - 1)).select(F.col("idx").alias("i"), F.col("e").alias("l_e")).toArrow()
                right = x.df.select(F.col("idx").alias("j"), F.col("e").alias("r_e")).toArrow()
                left = left.append_column("ti", [np.array([tile[0][k] for k in left["i"].to_pylist()], np.int32)])
                right = right.append_column("tj", [np.array([tile[1][k] for k in right["j"].to_pylist()], np.int32)])
                got = dots.dot_bounds(left, right, "l_e", "r_e", None if shift is None else 1 - shift)
                if part.stop == 40:
                    assert {(r["ti"], r["tj"]): (r["n"], r["top"], r["low"]) for r in got.to_pylist()} == {k: (len(v), max(d for d in v if d is not None), min(d for d in v if d is not None)) for k, v in want.items()}
        finally:
            dots.STEP, dots.MANY = before
        first = None if shift is None else 1 - shift
        met = p.map_blocks(lambda a, b, first=first: dots.dot_bounds(a, b, "l_e", "r_e", first), dots.TYPE)
        met = {(r.ti, r.tj): tuple(r)[2:] for r in met.groupBy("ti", "tj").agg(F.sum("n"), F.max("top"), F.min("low")).collect()}
        assert met == {k: (len(v), max(d for d in v if d is not None), min(d for d in v if d is not None)) for k, v in want.items()}


def test_dot_bounds_of_odd_numbers():
    import pyarrow as pa

    from rangeloom.operators.dots import dot_bounds

    e = pa.array([[1.0, math.inf], [2.0, 0.0], [1.0, 1.0], [3.0, 4.0]], pa.list_(pa.float32()))
    left = pa.table({"i": pa.array([0, 1, 2, 3]), "x": e, "ti": pa.array([0] * 4, pa.int32())})
    right = pa.table({"j": pa.array([0, 1, 2, 3]), "y": e, "tj": pa.array([0] * 4, pa.int32())})
    row = dot_bounds(left, right, "x", "y", 1).to_pylist()[0]
    assert row["n"] == 6 and math.isnan(row["top"]) and row["low"] == 2.0


def test_fold_in_levels(spark):
    from rangeloom.operators.reduce import fold_in_levels

    rng = random.Random(4)
    keys = [*range(-700, 900), 10**12, -(10**15)]
    rows = [(k, rng.choice("abc")) for k in keys]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "idx long, s string").repartition(5)
    join = lambda a, b: F.concat(a, b)
    assert fold_in_levels(df, join, "s").first().result == "".join(s for _, s in sorted(rows))
    assert fold_in_levels(df.where("idx = 5"), join, "s").first().result == dict(rows)[5]
    assert fold_in_levels(df.where("false"), join, "s").first().result is None
    assert fold_in_levels(spark.createDataFrame([(None, "z"), (1, "b"), (1, "a")], "idx long, s string"), join, "s").first().result == "abz"
    # A step on a long state taken once for each element would copy 10 ** 11 bytes here.
    long = spark.range(0, 500_000, 1, 4).select(F.col("id").alias("idx"), F.col("id").cast("string").substr(-1, 1).alias("s"))
    assert fold_in_levels(long, join, "s").first().result == "0123456789" * 50_000


def test_sibling_sums(spark):
    rng = random.Random(5)
    for _ in range(1):
        x, y = (IndexedFrame(some_list(spark, rng).df.dropDuplicates(["idx"]).localCheckpoint(), "idx") for _ in range(2))
        p = x.product(y)
        want = p.siblings((F.col("l_v") * F.col("r_v")).cast("long"), s=lambda v, di, dj: F.sum(v))
        assert same(p.sibling_sums("s", F.col("l_v"), F.col("r_v")), want)
    with pytest.raises(ValueError):
        x.combination().sibling_sums("s", F.col("l_v"), F.col("r_v"))


def test_sums(spark):
    """With gaps, equal indices, nulls, shifts and tiles, against the pairs."""
    f, g, both = F.col("l_v"), F.col("r_v"), (F.col("l_v") * F.col("r_v")).cast("long")
    for p in some_products(spark):
        sums = {"n": EACH, "t": times(f, g), "u": times(F.col("i"), F.lit(10)) + times(F.lit(1), F.col("j"))}
        made = {"n": F.count(F.lit(1)), "t": F.sum(both), "u": F.sum(F.col("i") * 10 + F.col("j"))}
        assert same(p.sums(**sums), p.reduce(**made))
        assert same(p.sum_tiles(**sums), p.reduce_tiles(**made))
        for how in ("block", "random"):
            want = p.dealt(3, how, seed=2).groupBy("part").agg(*[c.alias(k) for k, c in made.items()])
            assert same(p.sum_dealt(3, how, seed=2, **sums), want)


def test_sums_of_many(spark):
    n = 400_000
    x = IndexedFrame.generate(spark, LongRange(0, n), v=F.lit(3))
    row = x.combination().sums(n=EACH, total=times(F.col("l_v"), F.col("r_v"))).first()
    assert (row.n, row.total) == (n * (n - 1) // 2, 9 * n * (n - 1) // 2)


def test_sums_of_all_pairs(spark):
    n, m = 60_000, 1_200_000
    x, y = IndexedFrame.generate(spark, LongRange(0, n)), IndexedFrame.generate(spark, LongRange(0, m), v=F.lit(2))
    row = x.product(y).sums(n=EACH, total=times(F.col("i"), F.col("r_v"))).first()
    assert (row.n, row.total) == (n * m, n * (n - 1) * m)


def test_tasks_of_pairs_are_bounded(spark):
    """However few tiles are asked for, pairs meet in tiles of work."""
    from rangeloom.operators.product import TILE

    n = 2 * TILE
    p = IndexedFrame.generate(spark, LongRange(0, n)).combination().split(1, 1)
    found = p.pairs().groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in found) == n * (n - 1) // 2
    assert len(found) > 1 and max(r.n for r in found) < n * (n - 1) // 2


def test_scatter_sums(spark):
    for p in some_products(spark):
        assert same(p.scatter_sums(F.col("r_v"), F.col("l_v")), p.scatter((F.col("i"), F.col("r_v")), (F.col("j"), F.col("l_v"))))
        assert same(p.scatter_sums(inner=F.col("l_v")), p.scatter((F.col("j"), F.col("l_v"))))


def test_covered(spark):
    from rangeloom.operators.interval import covered, range_join

    rng = random.Random(8)
    rows = spark.createDataFrame([(rng.choice([None, *range(-50, 60)]),) for _ in range(150)], "idx long")
    starts = [(rng.randrange(-70, 70), rng.choice([0, 1, 2, 9, 40, 100, -3])) for _ in range(80)] + [(10**14, 5), (-(10**15), 10**15 - 20)]
    ranges = spark.createDataFrame([(a, a + k) for a, k in starts] + [(None, 3), (4, None)], "start long, stop long")
    want = range_join(rows, ranges.where("start < stop")).groupBy("idx").agg(F.count(F.lit(1)).alias("n"), F.max("stop").alias("last"))
    assert same(covered(rows, ranges), want)
    assert covered(rows, ranges.where("false")).count() == 0 and covered(rows.where("false"), ranges).count() == 0


def test_scans_of_partners(spark):
    for k, p in enumerate([*some_products(spark)][1:3]):
        for within in (LongRange(-9, 9) if k else None,):
            v, w = F.col("l_v"), F.col("r_v")
            got = p.scan_inner(within, n=("count", F.lit(1)), c=("count", v), s=("sum", v), low=("min", v), top=("max", v))
            assert same(got, p.reduce_inner(within, n=F.count(F.lit(1)), c=F.count(v), s=F.sum(v), low=F.min(v), top=F.max(v)))
            got = p.scan_outer(within, n=("count", F.lit(1)), c=("count", w), s=("sum", w), low=("min", w), top=("max", w))
            assert same(got, p.reduce_outer(within, n=F.count(F.lit(1)), c=F.count(w), s=F.sum(w), low=F.min(w), top=F.max(w)))
