"""Products of lists and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions.ranges import LongRange, SquareRange, split_squares, split_two_levels
from rangeloom.operators.accumulate import accept
from rangeloom.operators.dots import TYPE as DOTS
from rangeloom.operators.dots import dot_bounds
from rangeloom.operators.grid import GridFrame, TiledGrid
from rangeloom.operators.indexed import IndexedFrame
from rangeloom.operators.product import EACH, Product, times
from rangeloom.queries import money, query
from rangeloom.queries.lists import suppliers, total_of
from rangeloom.sources.tables import table


def rows() -> Column:
    return F.count(F.lit(1))


def parts(spark: SparkSession, sf_dir: str) -> IndexedFrame:
    return IndexedFrame(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")


@query("SELECT count(*) AS n, CAST(sum(s.s_suppkey * p.p_size) AS BIGINT) AS total FROM supplier s CROSS JOIN part p")
def product_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers(spark, sf_dir).product(parts(spark, sf_dir)).sums(n=EACH, total=times(F.col("i"), F.col("r_p_size")))


@query("SELECT count(*) AS n, CAST(sum(a.p_size * b.p_size) AS BIGINT) AS total FROM part a JOIN part b ON a.p_partkey < b.p_partkey")
def product_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = parts(spark, sf_dir)
    return x.combination().sums(n=EACH, total=times(F.col("l_p_size"), F.col("r_p_size")))


@query("SELECT a.s_suppkey AS i, b.s_suppkey AS j, a.s_acctbal AS l_s_acctbal, b.s_acctbal AS r_s_acctbal FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey")
def combination_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = IndexedFrame(suppliers(spark, sf_dir).df.select("s_suppkey", "s_acctbal"), "s_suppkey")
    return x.combination().pairs().drop("ti", "tj")


@query("SELECT count(*) AS n, CAST(sum(a.s_suppkey * 1000 + b.s_suppkey) AS BIGINT) AS total FROM supplier a JOIN supplier b ON b.s_suppkey >= a.s_suppkey + 1 - 3")
def product_triangle_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = suppliers(spark, sf_dir)
    return Product.triangle(x, x, shift=3).split(4, 3).sums(n=EACH, total=times(F.col("i"), F.lit(1000)) + times(F.lit(1), F.col("j")))


@query("SELECT a.s_suppkey AS i, count(*) AS n, max(b.s_acctbal) AS top FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey WHERE a.s_suppkey >= 5 AND a.s_suppkey < 60 GROUP BY 1")
def product_per_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers(spark, sf_dir).combination().scan_outer(LongRange(5, 60), n=("count", F.lit(1)), top=("max", F.col("r_s_acctbal")))


@query("SELECT b.s_suppkey AS j, count(*) AS n, min(a.s_acctbal) AS low FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey GROUP BY 1")
def product_per_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers(spark, sf_dir).combination().scan_inner(n=("count", F.lit(1)), low=("min", F.col("l_s_acctbal")))


@query("""
WITH a AS (SELECT s_suppkey AS i, CAST(ntile(3) OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS ti FROM supplier), b AS (SELECT s_suppkey AS j, CAST(ntile(5) OVER (ORDER BY s_suppkey) - 1 AS INTEGER) AS tj FROM supplier)
SELECT ti, tj, count(*) AS n, CAST(sum(i * j) AS BIGINT) AS total FROM a JOIN b ON i < j GROUP BY ti, tj""")
def product_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = suppliers(spark, sf_dir)
    return x.combination().split(3, 5).sum_tiles(n=EACH, total=times(F.col("i"), F.col("j")))


@query("SELECT a.s_suppkey AS i, p_partkey AS j, a.s_acctbal AS balance, p_size AS size FROM supplier a CROSS JOIN part WHERE a.s_suppkey >= 3 AND a.s_suppkey < 9 AND p_partkey >= 10 AND p_partkey < 40")
def product_sub_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = suppliers(spark, sf_dir).product(parts(spark, sf_dir)).sub_view(SquareRange(LongRange(3, 9), LongRange(10, 40)))
    return view.map(balance=F.col("l_s_acctbal"), size=F.col("r_p_size"))


@query("""
SELECT 'inner' AS side, s_suppkey AS idx FROM supplier WHERE s_suppkey > 40 UNION ALL SELECT 'outer', s_suppkey FROM supplier WHERE s_suppkey < 12""")
def product_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = suppliers(spark, sf_dir).combination()
    a = p.inner_pairs(40).select(F.lit("inner").alias("side"), F.col("s_suppkey").alias("idx"))
    return a.unionByName(p.outer_pairs(12).select(F.lit("outer").alias("side"), F.col("s_suppkey").alias("idx")))


@query("SELECT a.s_suppkey AS i, p_partkey AS j, s_name AS l_s_name, p_size AS r_p_size FROM supplier a CROSS JOIN part WHERE a.s_suppkey = 4 AND p_partkey = 9")
def product_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = suppliers(spark, sf_dir).product(parts(spark, sf_dir)).get(4, 9)
    return spark.createDataFrame([(r.i, r.j, r.l_s_name, r.r_p_size)], "i long, j long, l_s_name string, r_p_size int")


@query("SELECT how, CAST((SELECT count(*) * (count(*) - 1) // 2 FROM supplier) AS BIGINT) AS n FROM (VALUES ('block'), ('cyclic'), ('random')) t(how)")
def product_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = suppliers(spark, sf_dir).combination().split(4, 4)
    each = [p.sum_dealt(3, how, seed=42, n=EACH).agg(F.lit(how).alias("how"), F.sum("n").alias("n")) for how in ("block", "cyclic", "random")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("""
WITH a AS (SELECT vec_id AS i, embedding AS x, CAST(ntile(4) OVER (ORDER BY vec_id) - 1 AS INTEGER) AS ti FROM embeddings), b AS (SELECT i AS j, x AS y, ti AS tj FROM a),
     p AS (SELECT ti, tj, round(list_sum(list_transform(list_zip(x, y), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 4) AS dot FROM a JOIN b ON i < j)
SELECT ti, tj, count(*) AS n, max(dot) AS top, min(dot) AS low FROM p GROUP BY ti, tj""")
def embedding_pairs_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot products of all pairs of embeddings, by tile."""
    x = IndexedFrame(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    p = x.combination().split(4, 4)
    found = p.map_blocks(lambda a, b: dot_bounds(a, b, "l_embedding", "r_embedding", 1), DOTS)
    return found.groupBy("ti", "tj").agg(F.sum("n").alias("n"), F.round(F.max("top"), 4).alias("top"), F.round(F.min("low"), 4).alias("low"))


@query("""
WITH p AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j, a.s_nationkey AS x, b.s_nationkey AS y FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey),
     d AS (SELECT i AS idx, y AS v FROM p UNION ALL SELECT j, x FROM p)
SELECT s_suppkey, s_nationkey + (SELECT CAST(sum(v) AS BIGINT) FROM d WHERE idx = s_suppkey) AS force FROM supplier""")
def scatter_pairs_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pair interactions do: each pair adds to both of its elements."""
    x = IndexedFrame(suppliers(spark, sf_dir).df.select("s_suppkey", F.col("s_nationkey").cast("long").alias("s_nationkey")), "s_suppkey")
    acc = x.combination().split(3, 3).scatter_sums(F.col("r_s_nationkey"), F.col("l_s_nationkey"))
    return accept(x.map(s_nationkey=F.col("s_nationkey"), force=F.col("s_nationkey")), acc, force=F.col("s_nationkey") + F.col("acc_delta")).df.select("s_suppkey", "force")


# ---- grids --------------------------------------------------------------------------------------


def talks(spark: SparkSession, sf_dir: str) -> GridFrame:
    """``conversations`` as a sparse grid: the first row of each (conv_id, turn)."""
    df = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.length("text")).cast("long").alias("size"), F.min("role").alias("role"))
    return GridFrame(df, "conv_id", "turn", SquareRange(LongRange(0, 1 << 40), LongRange(0, 64)))


TALKS = "(SELECT conv_id, turn, min(length(text)) AS size, min(role) AS role FROM conversations GROUP BY 1, 2)"


@query("SELECT i, j, i * 10 + j AS value FROM range(2, 30) a(i), range(5, 25) b(j)")
def grid_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GridFrame.generate(spark, SquareRange(LongRange(2, 30), LongRange(5, 25)), value=F.col("i") * 10 + F.col("j")).df


@query("SELECT i, j FROM range(1, 40) a(i), range(2, 30) b(j) WHERE j >= i + 1 - 2")
def triangle_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SquareRange(LongRange(1, 40), LongRange(2, 30), True, 2).frame(spark)


@query("SELECT k AS tile, (SELECT count(*) FROM range(1, 10) a(i), range(2, 10) b(j) WHERE i < j AND i >= 1 + 3 * (k // 3) AND i < 4 + 3 * (k // 3) AND j >= [2, 5, 8, 10][k % 3 + 1] AND j < [2, 5, 8, 10][k % 3 + 2]) AS size FROM range(9) t(k)")
def square_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = SquareRange(LongRange(1, 10), LongRange(2, 10), True).split(3, 3)
    return spark.createDataFrame([(k, t.size) for k, t in enumerate(tiles)], "tile long, size long")


@query(f"SELECT conv_id, count(*) AS n, max(size) AS longest FROM {TALKS} WHERE conv_id >= 10 AND conv_id < 60 GROUP BY conv_id")
def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).reduce_rows(LongRange(10, 60), n=rows(), longest=F.max("size"))


@query(f"SELECT turn, count(*) AS n, CAST(sum(size) AS BIGINT) AS total FROM {TALKS} GROUP BY turn")
def grid_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).reduce_columns(n=rows(), total=F.sum("size"))


@query(f"SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM {TALKS} GROUP BY conv_id")
def grid_row_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).row_lists("role").select("conv_id", F.array_join("values", ",").alias("roles"))


@query(f"SELECT conv_id, turn, size FROM {TALKS} WHERE conv_id >= 5 AND conv_id < 40 AND turn >= 1 AND turn < 4")
def grid_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).view(SquareRange(LongRange(5, 40), LongRange(1, 4))).df.select("conv_id", "turn", "size")


@query(f"SELECT conv_id, turn, CASE WHEN turn < 2 THEN size + 100 ELSE size END AS size FROM {TALKS} WHERE turn != 5")
def grid_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = talks(spark, sf_dir)
    return GridFrame(x.df.where("turn != 5"), "conv_id", "turn").update(SquareRange(LongRange(0, 1 << 40), LongRange(0, 2)), size=F.col("size") + 100).df.select("conv_id", "turn", "size")


@query(f"SELECT a.conv_id, a.turn, CAST(sum(b.size) AS BIGINT) AS total, count(*) AS n FROM {TALKS} a JOIN {TALKS} b ON abs(a.conv_id - b.conv_id) <= 1 AND abs(a.turn - b.turn) <= 1 GROUP BY 1, 2")
def grid_siblings_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).siblings("size", total=lambda v, di, dj: F.sum(v), n=lambda v, di, dj: F.count(v))


@query(f"SELECT a.conv_id, a.turn, b.size AS before FROM {TALKS} a LEFT JOIN {TALKS} b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def grid_sibling_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return talks(spark, sf_dir).siblings("size", before=lambda v, di, dj: F.max(F.when((di == 0) & (dj == -1), v)))


@query("""
WITH c AS (SELECT i, j, i * 100 + j AS v, CAST(i // 4 AS INTEGER) AS ti, CAST(j // 3 AS INTEGER) AS tj FROM range(12) a(i), range(9) b(j))
SELECT ti, tj, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM c GROUP BY ti, tj""")
def grid_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = GridFrame.generate(spark, SquareRange(LongRange(0, 12), LongRange(0, 9)), v=F.col("i") * 100 + F.col("j"))
    return g.with_tile(3, 3).groupBy("ti", "tj").agg(rows().alias("n"), F.sum("v").alias("total"))


@query("SELECT i, j, 1 AS v FROM range(0, 4) a(i), range(0, 4) b(j) UNION ALL SELECT i, j, 2 FROM range(10, 13) a(i), range(2, 5) b(j)")
def tiled_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = GridFrame.generate(spark, SquareRange(LongRange(0, 4), LongRange(0, 4)), v=F.lit(1))
    b = GridFrame.generate(spark, SquareRange(LongRange(10, 13), LongRange(2, 5)), v=F.lit(2))
    c = GridFrame.generate(spark, SquareRange(LongRange(20, 22), LongRange(2, 5)), v=F.lit(3))
    return TiledGrid(a.df, [a.square]).add(b).add(c).remove(c.square).df


@query(f"SELECT turn AS conv_id, conv_id + 3 AS turn, size FROM {TALKS}")
def grid_transpose_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = GridFrame(talks(spark, sf_dir).df, "conv_id", "turn").translate(3, 0).transpose()
    return x.df.select(F.col(x.i).alias("conv_id"), F.col(x.j).alias("turn"), "size")


@query("SELECT a.s_suppkey AS i, p_partkey AS j, CAST(a.s_acctbal * p_size AS DOUBLE) AS v FROM supplier a CROSS JOIN part WHERE a.s_suppkey < 8 AND p_partkey < 8")
def product_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = suppliers(spark, sf_dir).product(parts(spark, sf_dir)).sub_view(SquareRange(LongRange(0, 8), LongRange(0, 8)))
    return view.to_grid(v=F.col("l_s_acctbal") * F.col("r_p_size")).df



@query("SELECT i, j, i * 100 + j AS value FROM range(0, 25) a(i), range(0, 25) b(j) WHERE i < j")
def grid_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GridFrame.generate(spark, SquareRange(LongRange(0, 25), LongRange(0, 25), True), value=F.col("i") * 100 + F.col("j")).df


@query("""
WITH p AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j, a.s_nationkey * b.s_nationkey AS v FROM supplier a, supplier b), d AS (SELECT di, dj FROM range(-1, 2) a(di), range(-1, 2) b(dj)),
     s AS (SELECT i + di AS i, j + dj AS j, v FROM p, d)
SELECT i, j, CAST(sum(v) AS BIGINT) AS around FROM s SEMI JOIN p USING (i, j) GROUP BY i, j""")
def product_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = suppliers(spark, sf_dir)
    return x.product(x).sibling_sums("around", F.col("l_s_nationkey"), F.col("r_s_nationkey"))


@query("SELECT true AS same, false AS different")
def grid_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = talks(spark, sf_dir)
    first = g.df.agg(F.min(F.struct("conv_id", "turn"))).first()[0]
    row = (g.equals(GridFrame(g.df.repartition(7), "conv_id", "turn")), g.equals(g.set(first.conv_id, first.turn, role="nobody")))
    return spark.createDataFrame([row], "same boolean, different boolean")


@query(f"""
SELECT a.conv_id, a.turn, CASE WHEN b.size IS NULL THEN a.size ELSE a.size - b.size END AS size
FROM {TALKS} a LEFT JOIN (SELECT conv_id, turn + 1 AS turn, size FROM {TALKS}) b ON a.conv_id = b.conv_id AND a.turn = b.turn""")
def grid_setup_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells worked out from those of another grid, here the same one moved by a turn."""
    g = talks(spark, sf_dir)
    return g.setup_from(GridFrame(g.df, "conv_id", "turn").translate(0, 1), size=F.col("size") - F.col("r_size")).df.select("conv_id", "turn", "size")


@query(f"""
SELECT conv_id, turn, CASE WHEN turn = 2 THEN 0 WHEN conv_id = 3 AND turn = 1 THEN -1 ELSE size END AS size, (SELECT coalesce(bool_or(role = 'user'), false) FROM {TALKS} WHERE conv_id = 3) AS in_row FROM {TALKS}""")
def grid_row_and_column_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row and a column as lists that are searched, changed, and put back."""
    g = talks(spark, sf_dir)
    row, column = g.row_list(3), g.column_list(2)
    out = g.with_row(3, row.set_unchecked(1, size=-1)).with_column(2, column.update(size=F.lit(0).cast("long")))
    return out.df.select("conv_id", "turn", "size").withColumn("in_row", F.lit(row.contains("role", "user")))


@query("SELECT how, part, CAST(n AS BIGINT) AS n FROM (VALUES ('lists', 0, 3), ('lists', 1, 2), ('lists', 2, 2), ('lists', 3, 2), ('hosts', 0, 3), ('hosts', 1, 2), ('hosts', 2, 2), ('hosts', 3, 2)) t(how, part, n) UNION ALL SELECT 'pairs', 0, 36")
def tiles_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine tiles of a triangle dealt to four lists, and to two hosts with two workers each; no pair is lost."""
    tiles = SquareRange(LongRange(1, 10), LongRange(2, 10), True).split(3, 3)
    lists, hosts = split_squares(4, tiles, seed=5), [w for h in split_two_levels(2, 2, tiles) for w in h]
    found = [("lists", k, len(x)) for k, x in enumerate(lists)] + [("hosts", k, len(x)) for k, x in enumerate(hosts)]
    return spark.createDataFrame(found + [("pairs", 0, sum(t.size for x in lists for t in x))], "how string, part int, n long")


@query(f"SELECT CAST(sum(size * (turn + 1)) AS BIGINT) AS total FROM {TALKS}")
def grid_for_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = total_of(spark, talks(spark, sf_dir).for_each, lambda r: r["size"] * (r.turn + 1))
    return spark.createDataFrame([(total,)], "total long")


@query("""
WITH p AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j, a.s_nationkey AS x, b.s_nationkey AS y FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey),
     d AS (SELECT i AS idx, y AS v FROM p UNION ALL SELECT j, x FROM p)
SELECT s_suppkey, 2 * (SELECT CAST(sum(v) AS BIGINT) FROM d WHERE idx = s_suppkey) AS force FROM supplier""")
def accumulator_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of scatter and gather: what is sent in the second begins from nothing again."""
    x = IndexedFrame(suppliers(spark, sf_dir).df.select("s_suppkey", F.col("s_nationkey").cast("long").alias("n"), F.lit(0).cast("long").alias("force")), "s_suppkey")
    for _ in range(2):
        acc = x.combination().split(2, 2).scatter_sums(F.col("r_n"), F.col("l_n"))
        x = accept(x, acc, force=F.col("force") + F.col("acc_delta"))
    return x.df.select("s_suppkey", "force")
