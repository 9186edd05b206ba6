"""Lists: making, slicing, mapping, zipping, chunks, ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions.ranges import LongRange, chunk_order, null_safe_equals, range_intersection, ranges_overlap, slice_bounds
from rangeloom.operators import rangeset
from rangeloom.operators.indexed import IndexedFrame, prefix_sum
from rangeloom.operators.interval import covered, floor_join, range_join
from rangeloom.operators.rangeset import RangeSet
from rangeloom.operators.reduce import fold_in_levels, top_k
from rangeloom.queries import money, query
from rangeloom.sources.scratch import new_path
from rangeloom.sources.tables import bag, indexed


def orders(spark: SparkSession, sf_dir: str) -> IndexedFrame:
    return indexed(spark, sf_dir, "orders", "o_orderkey")


def customers(spark: SparkSession, sf_dir: str) -> IndexedFrame:
    return indexed(spark, sf_dir, "customer", "c_custkey")


def suppliers(spark: SparkSession, sf_dir: str) -> IndexedFrame:
    return indexed(spark, sf_dir, "supplier", "s_suppkey")


#: Ranges that several queries use.
RANGES = [LongRange(0, 100), LongRange(150, 200), LongRange(200, 300), LongRange(700, 705)]
VALUES = "(VALUES (0::BIGINT, 100::BIGINT), (150, 200), (200, 300), (700, 705)) r(start, stop)"
OTHER = [LongRange(50, 160), LongRange(180, 220), LongRange(702, 800)]
OTHER_VALUES = "(VALUES (50::BIGINT, 160::BIGINT), (180, 220), (702, 800)) q(start, stop)"


@query("SELECT i AS idx FROM range(100, 250) t(i)")
def index_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LongRange(100, 250).frame(spark)


@query("SELECT i AS idx, i * i + 1 AS square, 'x' AS constant, CAST(NULL AS INTEGER) AS nothing FROM range(10, 60) t(i)")
def list_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IndexedFrame.generate(spark, LongRange(10, 60), square=F.col("idx") * F.col("idx") + 1, constant="x", nothing=F.lit(None).cast("int")).df


@query("SELECT * FROM (VALUES (5::BIGINT, 3), (6, -2), (7, 7), (8, 6), (9, -6)) t(idx, value)")
def list_from_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IndexedFrame.from_values(spark, LongRange(5, 10), [3, -2, 7, 6, -6], kind="int").df


@query("""
SELECT o_orderkey // 1000 AS range_id, o_orderkey // 1000 * 1000 AS start, (o_orderkey // 1000 + 1) * 1000 AS stop, count(*) AS n,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, max(o_totalprice) AS top, min(o_totalprice) AS low
FROM orders GROUP BY ALL""")
def chunk_reduce_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = "o_totalprice"
    return orders(spark, sf_dir).reduce_blocks(1000, n=F.count(F.lit(1)), total=F.sum(money(price)).cast("double"), top=F.max(price), low=F.min(price))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900")
def range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).slice(LongRange(100, 900)).df.select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"SELECT o_orderkey, o_custkey, start, stop FROM orders JOIN {VALUES} ON o_orderkey >= start AND o_orderkey < stop")
def range_slice_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).slices(RangeSet(RANGES).frame(spark)).select("o_orderkey", "o_custkey", "start", "stop")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 40 AND o_orderkey <= 60")
def range_scan_backwards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).iterate(LongRange(40, 1000), start=60, reverse=True)
    return spark.createDataFrame([(r.o_orderkey, r.o_totalprice) for r in rows], "o_orderkey long, o_totalprice double")


@query("SELECT o_orderkey, o_custkey * 2 AS twice, upper(o_orderstatus) || '-' || o_orderpriority AS label FROM orders")
def map_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).map(twice=F.col("o_custkey") * 2, label=F.concat(F.upper("o_orderstatus"), F.lit("-"), F.col("o_orderpriority"))).df


@query("SELECT o_orderkey, o_orderkey * 10 + o_custkey % 10 AS mixed FROM orders")
def map_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).map(mixed=F.col("o_orderkey") * 10 + F.col("o_custkey") % 10).df


@query("SELECT i AS idx, i * i AS square, i * i * i AS cube FROM range(10, 20) t(i)")
def lazy_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return IndexedFrame.generate(spark, LongRange(10, 20), v=F.col("idx")).lazy_map(square=v * v, cube=v * v * v).df


@query("SELECT o_orderkey, CASE WHEN o_orderkey >= 10 AND o_orderkey < 500 THEN o_custkey + 2 ELSE o_custkey END AS o_custkey FROM orders")
def for_each_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).update(LongRange(10, 500), o_custkey=F.col("o_custkey") + 2).df.select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 7 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def set_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).set(7, o_orderstatus="Z").df.select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 42")
def get_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = orders(spark, sf_dir).get(42)
    return spark.createDataFrame([(row.o_orderkey, row.o_custkey)], "o_orderkey long, o_custkey long")


@query("SELECT c_custkey, c_acctbal + s_acctbal AS both, s_name FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_custkey < 80")
def zip_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = customers(spark, sf_dir).zip_map(suppliers(spark, sf_dir), LongRange(0, 80), both=F.col("c_acctbal") + F.col("r1_s_acctbal"), s_name=F.col("r1_s_name"))
    return out.df


@query("""
SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(18,2)) * CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS dot, count(*) AS n
FROM customer JOIN supplier ON c_custkey = s_suppkey""")
def zip_fold_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = money("c_acctbal") * money("r1_s_acctbal")
    return customers(spark, sf_dir).zip_fold(suppliers(spark, sf_dir), dot=F.sum(pairs).cast("double"), n=F.count(F.lit(1)))


@query("SELECT c_custkey, c_name, coalesce(s_name, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND c_custkey < 50")
def setup_from_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = customers(spark, sf_dir).setup_from(suppliers(spark, sf_dir), within=LongRange(0, 50), c_mktsegment=F.col("r1_s_name"))
    return out.df.select("c_custkey", "c_name", "c_mktsegment")


@query("""
SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL AND s_suppkey IS NOT NULL THEN c_acctbal - s_acctbal ELSE o_totalprice END AS o_totalprice
FROM orders LEFT JOIN customer ON c_custkey = o_orderkey LEFT JOIN supplier ON s_suppkey = o_orderkey""")
def setup_from_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.col("r1_c_acctbal") - F.col("r2_s_acctbal")
    return orders(spark, sf_dir).setup_from(customers(spark, sf_dir), suppliers(spark, sf_dir), o_totalprice=made).df.select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'")
def filter_to_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = (F.col("o_totalprice") > 1000) & (F.col("o_orderstatus") == "F")
    return orders(spark, sf_dir).to_bag(F.array(F.when(keep, F.struct("o_orderkey", "o_totalprice")))).df


@query("SELECT l_orderkey, l_linenumber, k FROM (SELECT l_orderkey, l_linenumber, unnest(range(1, l_linenumber + 1)) AS k FROM lineitem)")
def flatmap_to_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.transform(F.sequence(F.lit(1).cast("long"), F.col("l_linenumber").cast("long")), lambda k: F.struct("l_orderkey", "l_linenumber", k.alias("k")))
    return IndexedFrame(bag(spark, sf_dir, "lineitem").df, "l_orderkey").to_bag(items).df


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey // 1000 IN
(SELECT o_orderkey // 1000 FROM orders GROUP BY 1 HAVING CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) > 249.9 * count(*) * 10)""")
def filter_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = orders(spark, sf_dir)
    top = x.df.agg(F.max("o_orderkey")).first()[0]
    chunked = IndexedFrame(x.df, "o_orderkey", [LongRange(k * 1000, k * 1000 + 1000) for k in range(top // 1000 + 1)])
    kept = chunked.filter_chunks(F.col("total") > 249.9 * F.col("n") * 10, total=F.sum(money("o_totalprice")).cast("double"), n=F.count(F.lit(1)))
    return kept.df.select("o_orderkey", "o_custkey")


@query("""
SELECT start, stop, count(o_orderkey) AS n, max(o_totalprice) AS top
FROM orders JOIN (VALUES (0::BIGINT, 100::BIGINT), (150, 200), (200, 300), (700, 705)) r(start, stop) ON o_orderkey >= start AND o_orderkey < stop
WHERE start < 250 AND stop > 120 GROUP BY ALL""")
def for_each_chunk_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = IndexedFrame(orders(spark, sf_dir).df, "o_orderkey", RANGES)
    return x.chunks(LongRange(120, 250)).groupBy("start", "stop").agg(F.count("o_orderkey").alias("n"), F.max("o_totalprice").alias("top"))


@query("""
SELECT (SELECT coalesce(bool_or(o_orderstatus = 'F'), false) FROM orders) AS has_f, (SELECT coalesce(bool_or(o_orderstatus = 'Q'), false) FROM orders) AS has_q,
       NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)) AS all_nations""")
def contains_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, c = orders(spark, sf_dir), customers(spark, sf_dir)
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey")
    row = (x.contains("o_orderstatus", "F"), x.contains("o_orderstatus", "Q"), c.contains_all(nations, "c_nationkey"))
    return spark.createDataFrame([row], "has_f boolean, has_q boolean, all_nations boolean")


@query(f"""
SELECT q.start, q.stop, coalesce(sum(greatest(0, least(q.stop, r.stop) - greatest(q.start, r.start))), 0) = q.stop - q.start AS covered
FROM (VALUES (160::BIGINT, 290::BIGINT), (90, 110), (700, 705), (150, 200)) q(start, stop) LEFT JOIN {VALUES} ON r.start < q.stop AND q.start < r.stop GROUP BY q.start, q.stop""")
def contains_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = IndexedFrame(orders(spark, sf_dir).df, "o_orderkey", RANGES)
    asked = [LongRange(160, 290), LongRange(90, 110), LongRange(700, 705), LongRange(150, 200)]
    return spark.createDataFrame([(r.start, r.stop, x.contains_range(r)) for r in asked], "start long, stop long, covered boolean")


@query("SELECT part - 1 AS part, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) AS part FROM orders) GROUP BY part")
def separate_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = orders(spark, sf_dir)
    return x.with_part(7).groupBy(F.col("part").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("SELECT part - 1 AS part, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, ntile(7) OVER (ORDER BY doc_id) AS part FROM labels) GROUP BY part")
def separate_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` has rows for some documents only."""
    x = indexed(spark, sf_dir, "labels", "doc_id")
    return x.with_part(7).groupBy(F.col("part").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("SELECT ntile - 1 AS part, min(i) AS start, max(i) + 1 AS stop FROM (SELECT i, ntile(7) OVER (ORDER BY i) AS ntile FROM range(10, 60) t(i)) GROUP BY ntile")
def split_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, r.start, r.stop) for k, r in enumerate(LongRange(10, 60).split(7))], "part long, start long, stop long")


@query("""
WITH x AS (SELECT start, stop, sum(stop - start) OVER (ORDER BY start) - (stop - start) AS pos FROM (VALUES (0::BIGINT, 100::BIGINT), (150, 200), (200, 300), (700, 705)) r(start, stop)),
     p AS (SELECT k, k * (255 // 4) + least(k, 255 % 4) AS a, (k + 1) * (255 // 4) + least(k + 1, 255 % 4) AS b FROM range(4) t(k))
SELECT k AS part, CAST(start + greatest(a, pos) - pos AS BIGINT) AS start, CAST(start + least(b, pos + stop - start) - pos AS BIGINT) AS stop FROM x JOIN p ON greatest(a, pos) < least(b, pos + stop - start)""")
def split_list_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangeset.split_frame(RangeSet(RANGES).frame(spark), 4).select(F.col("part").cast("long").alias("part"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query("SELECT * FROM (VALUES (80::BIGINT, 100::BIGINT), (150, 200), (200, 210)) t(start, stop)")
def split_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = IndexedFrame(orders(spark, sf_dir).df, "o_orderkey", RANGES).split_chunks(LongRange(80, 210))
    return RangeSet(x.ranges).frame(spark)


@query("""
SELECT a AS start, b AS stop FROM (
  SELECT unnest(list_sort(list_distinct(list_filter([start, 60, 180, stop], lambda x: x >= start AND x <= stop)))) AS a,
         unnest(list_sort(list_distinct(list_filter([start, 60, 180, stop], lambda x: x >= start AND x <= stop)))[2:]) AS b
  FROM (VALUES (0::BIGINT, 100::BIGINT), (150, 200), (200, 300), (700, 705)) r(start, stop)) WHERE b IS NOT NULL""")
def split_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangeset.cut(RangeSet(RANGES).frame(spark), 60, 180)


@query(f"""
SELECT o_orderkey, r.start, r.stop FROM orders JOIN {VALUES} ON o_orderkey >= r.start AND o_orderkey < r.stop
WHERE NOT EXISTS (SELECT 1 FROM {OTHER_VALUES} WHERE o_orderkey >= q.start AND o_orderkey < q.stop)""")
def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).df.select("o_orderkey")
    inside = range_join(rows, RangeSet(RANGES).frame(spark), "o_orderkey")
    own = inside.withColumnsRenamed({"start": "a", "stop": "b"})
    out = range_join(own, RangeSet(OTHER).frame(spark), "o_orderkey", "left_anti")
    return out.select("o_orderkey", F.col("a").alias("start"), F.col("b").alias("stop"))


@query("""
SELECT e.event_id, m.start, m.o_custkey FROM events e ASOF LEFT JOIN (SELECT o_orderkey AS start, o_custkey FROM orders WHERE o_orderstatus = 'F') m ON e.event_id >= m.start""")
def floor_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the last finished order at or below its number."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    marks = orders(spark, sf_dir).df.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("start"), "o_custkey")
    return floor_join(rows, marks, "event_id")


@query("""
WITH l AS (SELECT l_orderkey AS start, l_orderkey + CAST(l_quantity AS BIGINT) + CASE WHEN l_linenumber = 7 THEN 300 ELSE 0 END AS stop FROM lineitem WHERE l_returnflag = 'R')
SELECT o_orderkey, count(*) AS n, max(stop) AS last FROM orders JOIN l ON o_orderkey >= start AND o_orderkey < stop GROUP BY o_orderkey""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the ranges, of very different lengths, that returned lines make."""
    lines = bag(spark, sf_dir, "lineitem").df.where("l_returnflag = 'R'")
    stop = F.col("l_orderkey") + F.col("l_quantity").cast("long") + F.when(F.col("l_linenumber") == 7, F.lit(300)).otherwise(F.lit(0))
    return covered(orders(spark, sf_dir).df.select("o_orderkey"), lines.select(F.col("l_orderkey").alias("start"), stop.alias("stop")), "o_orderkey")


@query(f"SELECT greatest(r.start, q.start) AS start, least(r.stop, q.stop) AS stop FROM {VALUES} JOIN {OTHER_VALUES} ON greatest(r.start, q.start) < least(r.stop, q.stop)")
def range_set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangeset.intersect(RangeSet(RANGES).frame(spark), RangeSet(OTHER).frame(spark), 64)


@query("""
SELECT * FROM (VALUES ('overlap', 0::BIGINT, 100::BIGINT), ('overlap', 150, 200), ('include', 150, 200), ('include', 200, 300), ('head', 0, 100), ('head', 150, 200),
('tail', 200, 300), ('tail', 700, 705), ('split', 150, 160), ('floor', 150, 200), ('higher', 200, 300), ('retained', 700, 705)) t(what, start, stop)""")
def range_set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = RangeSet(RANGES)
    found = [("overlap", r) for r in s.overlap_set(90, 160)] + [("include", r) for r in s.include_set(120, 400)]
    found += [("head", r) for r in s.head_set(200)] + [("tail", r) for r in s.tail_set(200)]
    found += [("split", r) for r in RangeSet(RANGES).split(150, 160)]
    found += [("floor", s.floor(LongRange(160, 170))), ("higher", s.higher(LongRange(150, 200)))]
    kept = RangeSet(RANGES)
    kept.retain_all([LongRange(700, 705), LongRange(1, 2)])
    found += [("retained", r) for r in kept]
    return spark.createDataFrame([(w, r.start, r.stop) for w, r in found], "what string, start long, stop long")


@query(f"SELECT CAST(sum(stop - start) AS BIGINT) AS total_size FROM {VALUES}")
def range_total_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rangeset.total_size(RangeSet(RANGES).frame(spark))


@query(f"""
SELECT r.start AS a, r.stop AS b, q.start AS c, q.stop AS d, (r.start < q.stop AND q.start < r.stop) AS overlap,
       CASE WHEN greatest(r.start, q.start) < least(r.stop, q.stop) THEN greatest(r.start, q.start) END AS low
FROM {VALUES}, {OTHER_VALUES}""")
def range_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(r.start, r.stop, q.start, q.stop) for r in RANGES for q in OTHER]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    return df.withColumn("overlap", ranges_overlap("a", "b", "c", "d")).withColumn("low", range_intersection("a", "b", "c", "d")["start"])


@query("""
SELECT min(doc_id) AS start, max(doc_id) + 1 AS stop FROM (SELECT doc_id, doc_id - row_number() OVER (ORDER BY doc_id) AS g FROM labels) GROUP BY g""")
def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of documents that have labels."""
    return indexed(spark, sf_dir, "labels", "doc_id").runs(1000)


@query("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (ORDER BY o_orderkey) AS DOUBLE) AS prefix FROM orders")
def prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_sum(orders(spark, sf_dir).df.select("o_orderkey", "o_totalprice"), "o_orderkey", money("o_totalprice"), width=1024)
    return out.select("o_orderkey", F.col("prefix").cast("double").alias("prefix"))


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderkey >= 150 AND o_orderkey < 200)")
def remove_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir).df.select("o_orderkey")
    cuts = [0, 100, 150, 200, 1 << 40]
    parts = [LongRange(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    x, *rest = (IndexedFrame(df.where(r.where("o_orderkey")), "o_orderkey", [r]) for r in parts)
    for other in rest:
        x = x.add(other)
    return x.remove(LongRange(150, 200)).df


@query("SELECT * FROM (VALUES (true, false)) t(same, different)")
def list_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = orders(spark, sf_dir)
    b = IndexedFrame(a.df.repartition(5), "o_orderkey")
    row = (a.equals(b) and a.content_hash() == b.content_hash(), a.equals(a.set(3, o_custkey=-1)))
    return spark.createDataFrame([row], "same boolean, different boolean")


@query("SELECT string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS result FROM orders")
def fold_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = orders(spark, sf_dir).df.where("o_orderstatus IS NOT NULL")
    return fold_in_levels(texts, lambda a, b: F.concat(a, b), "o_orderstatus", order="o_orderkey")


@query("SELECT CAST(max(o_totalprice) AS DOUBLE) AS result, CAST(NULL AS DOUBLE) AS none FROM orders")
def fold_without_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, bigger = orders(spark, sf_dir), lambda a, b: F.greatest(a, b)
    some = fold_in_levels(x.df, bigger, "o_totalprice", order="o_orderkey")
    none = fold_in_levels(x.slice(LongRange(-9, -5)).df, bigger, "o_totalprice", order="o_orderkey").withColumnRenamed("result", "none")
    return some.join(none, F.lit(True))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25")
def topk_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(orders(spark, sf_dir).df.select("o_orderkey", "o_totalprice"), 25, "o_totalprice", "o_orderkey")


# ---- effects, access and checks ------------------------------------------------------------------


def total_of(spark: SparkSession, run: Callable[[Callable], None], value: Callable[[Row], int]) -> int:
    """What a side effect adds up to: ``run`` gets an action that adds each row's value to an accumulator."""
    seen = spark.sparkContext.accumulator(0)

    def action(rows: Iterable[Row]) -> None:
        for r in rows:
            seen.add(value(r))

    run(action)
    return seen.value


@query("""
SELECT 'each' AS how, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders UNION ALL SELECT 'indexed', CAST(sum(o_orderkey * (o_custkey % 10)) AS BIGINT) FROM orders
UNION ALL SELECT 'range', CAST(sum(o_custkey) AS BIGINT) FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 500
UNION ALL SELECT 'zip', CAST(sum(c_nationkey * s_nationkey) AS BIGINT) FROM customer JOIN supplier ON c_custkey = s_suppkey""")
def for_each_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side effects on a list's rows, with their index, in a range, and on two lists' rows met by index."""
    x, c, s = orders(spark, sf_dir), customers(spark, sf_dir), suppliers(spark, sf_dir)
    found = [
        ("each", total_of(spark, x.for_each, lambda r: r.o_custkey)), ("indexed", total_of(spark, x.for_each, lambda r: r.o_orderkey * (r.o_custkey % 10))),
        ("range", total_of(spark, lambda action: x.for_each(action, LongRange(10, 500)), lambda r: r.o_custkey)),
        ("zip", total_of(spark, lambda action: c.zip_for_each(s, action), lambda r: r.c_nationkey * r.r1_s_nationkey)),
    ]
    return spark.createDataFrame(found, "how string, total long")


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_orderkey) AS place FROM (SELECT o_orderkey FROM orders WHERE o_orderkey >= 0 AND o_orderkey < 40) UNION ALL SELECT -1, 3")
def sub_list_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range that reaches beyond the list is clipped; one outside of it, and two checks of ranges and chunks, fail."""
    x = IndexedFrame(orders(spark, sf_dir).df, "o_orderkey", [LongRange(0, 100), LongRange(100, 1 << 40)])
    got, failed = x.sub_list(LongRange(-60, 40)).to_list("o_orderkey"), 0
    for check in (lambda: x.sub_list(LongRange(-60, -40)), lambda: x.range_check(LongRange(-1, 5)), lambda: x.set(-7, o_custkey=0)):
        try:
            check()
        except IndexError:
            failed += 1
    x.range_check(LongRange(50, 150))
    return spark.createDataFrame([(r.o_orderkey, k + 1) for k, r in enumerate(got)] + [(-1, failed)], "o_orderkey long, place long")


@query("SELECT o_orderkey, CASE WHEN o_orderkey = 11 THEN -5 ELSE o_custkey END AS o_custkey FROM orders")
def unchecked_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Setting and getting without a look whether the index is there; where it isn't nothing changes."""
    x = orders(spark, sf_dir).set_unchecked(11, o_custkey=-5).set_unchecked(-3, o_custkey=1)
    return x.df.select("o_orderkey", "o_custkey") if x.get_unchecked(-3) is None else x.df.limit(0)


@query("SELECT r_regionkey, r_name, CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS BIGINT) AS place FROM region")
def collect_to_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small list on the driver, in order of the index."""
    got = IndexedFrame(spark.read.parquet(f"{sf_dir}/region.parquet").withColumn("r_regionkey", F.col("r_regionkey").cast("long")), "r_regionkey").to_list("r_regionkey", "r_name")
    return spark.createDataFrame([(r.r_regionkey, r.r_name, k) for k, r in enumerate(got)], "r_regionkey long, r_name string, place long")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_custkey AS decoded FROM orders")
def storage_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list written and read, as it is and in a form of the caller's own."""
    x, plain, own = orders(spark, sf_dir), new_path(spark, "list"), new_path(spark, "encoded")
    x.write(plain)
    x.write_encoded(own, lambda row: str(row["o_custkey"]).encode())
    back = IndexedFrame.read(spark, plain, "o_orderkey")
    decoded = IndexedFrame.read_encoded(spark, own, lambda raw: {"decoded": int(raw)}, "decoded long", "o_orderkey")
    return back.zipped(decoded).select("o_orderkey", "o_custkey", "o_orderstatus", F.col("r1_decoded").alias("decoded"))


@query("SELECT o_orderkey, o_custkey * 2 + CAST(o_custkey % 2 = 0 AS INTEGER) AS v FROM orders")
def task_local_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map with an object that each task makes for itself, here what it has worked out before."""

    def mapped(known: dict, batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [known.setdefault(c, c * 2 + (c % 2 == 0)) for c in batch.column("o_custkey").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("o_orderkey"), pa.array(values, pa.int64())], ["o_orderkey", "v"])

    x = orders(spark, sf_dir)
    return IndexedFrame(x.df.select("o_orderkey", "o_custkey"), "o_orderkey").map_batches(mapped, "o_orderkey long, v long", make=dict).df


@query(f"SELECT start, stop, CAST(row_number() OVER (ORDER BY start, stop DESC) - 1 AS BIGINT) AS place FROM (SELECT * FROM {VALUES} UNION ALL SELECT 150, 160 UNION ALL SELECT 0, 300)")
def range_ordering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by start, of those that start together the longest first."""
    found = sorted([*RANGES, LongRange(150, 160), LongRange(0, 300)], key=chunk_order)
    return spark.createDataFrame([(r.start, r.stop, k) for k, r in enumerate(found)], "start long, stop long, place long")


@query("SELECT k AS part, CAST(100 + k * (37 // 5) + least(k, 37 % 5) AS BIGINT) AS start, CAST(100 + (k + 1) * (37 // 5) + least(k + 1, 37 % 5) AS BIGINT) AS stop FROM range(5) t(k)")
def slice_bounds_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, *slice_bounds(37, 5, k, 100)) for k in range(5)], "part long, start long, stop long")


@query("SELECT a.o_orderkey, a.o_custkey IS NOT DISTINCT FROM b.o_custkey AS same FROM (SELECT o_orderkey, nullif(o_custkey % 10, 0) AS o_custkey FROM orders) a JOIN (SELECT o_orderkey, nullif(o_custkey % 5, 0) AS o_custkey FROM orders) b USING (o_orderkey)")
def null_safe_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir).df.select("o_orderkey", F.expr("nullif(o_custkey % 10, 0)").alias("a"), F.expr("nullif(o_custkey % 5, 0)").alias("b"))
    return df.select("o_orderkey", null_safe_equals("a", "b").alias("same"))
