"""Reductions of lists and bags, bags themselves, accumulators."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions.ranges import LongRange
from rangeloom.operators.accumulate import accept, scatter
from rangeloom.operators.bag import BagFrame
from rangeloom.operators.indexed import IndexedFrame
from rangeloom.operators.reduce import Reducer, exact_product, product_by, reduce_with, reduction, team_reduction
from rangeloom.queries import money, query
from rangeloom.queries.lists import customers, orders, suppliers
from rangeloom.sources.tables import bag


@query("""
SELECT CAST(sum(l_linenumber) AS BIGINT) AS i_sum, max(l_linenumber) AS i_max, min(l_linenumber) AS i_min, CAST(sum(l_partkey) AS BIGINT) AS l_sum,
       max(l_partkey) AS l_max, min(l_partkey) AS l_min, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS d_sum,
       max(l_extendedprice) AS d_max, min(l_discount) AS d_min FROM lineitem""")
def bag_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag(spark, sf_dir, "lineitem").reduce(
        i_sum=reduction("sum", "l_linenumber", "int"), i_max=reduction("max", "l_linenumber", "int"), i_min=reduction("min", "l_linenumber", "int"),
        l_sum=reduction("sum", "l_partkey"), l_max=reduction("max", "l_partkey"), l_min=reduction("min", "l_partkey"),
        d_sum=F.sum(money("l_extendedprice")).cast("double"), d_max=reduction("max", "l_extendedprice", "double"), d_min=reduction("min", "l_discount", "double"),
    )


@query("SELECT bool_and(o_totalprice >= 0) AS all_positive, bool_and(o_orderstatus = 'F') AS all_f, bool_or(o_orderstatus = 'F') AS any_f, bool_or(o_totalprice < 0) AS any_negative FROM orders")
def reduce_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return orders(spark, sf_dir).reduce(
        all_positive=reduction("and", price >= 0), all_f=reduction("and", status == "F"), any_f=reduction("or", status == "F"), any_negative=reduction("or", price < 0)
    )


@query("SELECT l_orderkey, CAST(product(l_linenumber) AS BIGINT) AS p FROM lineitem GROUP BY l_orderkey")
def reduce_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag(spark, sf_dir, "lineitem").df.groupBy("l_orderkey").agg(reduction("prod", "l_linenumber", "int").alias("p"))


@query("SELECT CAST(-12096 AS BIGINT) AS p, CAST(-2147483648 AS BIGINT) AS wrapped")
def reduce_product_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = IndexedFrame.from_values(spark, LongRange(0, 8), [3, -2, 7, 6, -6, 1, 4, -2], kind="int")
    twos = IndexedFrame.from_values(spark, LongRange(0, 31), [2] * 31, kind="int")
    return spark.createDataFrame([(exact_product(small.df, "value"), exact_product(twos.df, "value", 32))], "p long, wrapped long")


@query("""
SELECT CAST(((CAST(sum(l_partkey * 1000003) AS HUGEINT) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS BIGINT) AS int_sum,
       CAST(((CAST(sum(l_partkey * 1000003) AS HUGEINT) + 32768) % 65536 + 65536) % 65536 - 32768 AS BIGINT) AS short_sum FROM lineitem""")
def reduce_wrapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("l_partkey") * 1000003
    out = bag(spark, sf_dir, "lineitem").reduce(int_sum=reduction("sum", v, "int", wrap=True), short_sum=reduction("sum", v, "short", wrap=True))
    return out.select(F.col("int_sum").cast("long").alias("int_sum"), F.col("short_sum").cast("long").alias("short_sum"))


@query("""
SELECT true AS b_and, false AS b_or, CAST(0 AS BIGINT) AS i_sum, CAST(1 AS BIGINT) AS i_prod, CAST(-2147483648 AS INTEGER) AS i_max,
       CAST(2147483647 AS INTEGER) AS i_min, CAST(-9223372036854775808 AS BIGINT) AS l_max, CAST(0 AS DOUBLE) AS d_sum, CAST('-inf' AS DOUBLE) AS d_max,
       CAST(4.9e-324 AS DOUBLE) AS d_max_compat""")
def reduce_empty_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = orders(spark, sf_dir).slice(LongRange(-10, -5))
    key, price = "o_custkey", "o_totalprice"
    return none.reduce(
        b_and=reduction("and", F.col(price) > 0), b_or=reduction("or", F.col(price) > 0), i_sum=reduction("sum", key, "int"), i_prod=reduction("prod", key, "int"),
        i_max=reduction("max", key, "int"), i_min=reduction("min", key, "int"), l_max=reduction("max", key), d_sum=reduction("sum", price, "double"),
        d_max=reduction("max", price, "double"), d_max_compat=reduction("max", price, "double", compat=True),
    )


@query("SELECT max(o_totalprice) AS top, min(o_totalprice) AS low FROM orders WHERE o_orderkey % 10 != 0")
def reduce_ignores_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("o_orderkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    return orders(spark, sf_dir).reduce(top=reduction("max", v, "double"), low=reduction("min", v, "double"))


@query("""
WITH p AS (SELECT l_suppkey, list_reduce(list(CAST(2 * l_partkey + 1 AS HUGEINT)), lambda a, b: a * b % 18446744073709551616) AS p FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, CAST(CASE WHEN p >= 9223372036854775808 THEN p - 18446744073709551616 ELSE p END AS BIGINT) AS product FROM p""")
def reduce_product_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products far beyond 64 bits, which wrap around."""
    return product_by(bag(spark, sf_dir, "lineitem").df, F.col("l_partkey") * 2 + 1, "l_suppkey")


class Smallest(Reducer):
    """The k smallest (value, index) pairs: a state of k entries, whatever it has seen."""

    def __init__(self, k: int, value: str, idx: str):
        self.k, self.value, self.idx = k, value, idx

    def zero(self) -> list:
        return []

    def reduce(self, state: list, row: dict) -> list:
        item = (-row[self.value], -row[self.idx])
        if len(state) < self.k:
            heapq.heappush(state, item)
        elif item > state[0]:
            heapq.heapreplace(state, item)
        return state

    def merge(self, a: list, b: list) -> list:
        return heapq.nlargest(self.k, a + b)[::-1]

    def result(self, state: list) -> list:
        return sorted((-v, -i) for v, i in state)


@query("SELECT o_orderkey AS idx, o_totalprice AS value FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 3")
def user_reducer_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reduce_with(orders(spark, sf_dir).df, Smallest(3, "o_totalprice", "o_orderkey"), "o_orderkey", "o_totalprice")
    return spark.createDataFrame([(i, v) for v, i in found], "idx long, value double")


@query("SELECT c_custkey, m.top FROM customer CROSS JOIN (SELECT max(c_acctbal) AS top FROM customer) m")
def team_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = customers(spark, sf_dir)
    return team_reduction(x.df.select("c_custkey"), x.reduce(top=reduction("max", "c_acctbal", "double")))


@query("SELECT 'A' AS side, l_orderkey AS idx, l_linenumber AS n FROM lineitem UNION ALL SELECT 'B', o_orderkey, 0 FROM orders")
def bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = bag(spark, sf_dir, "lineitem").map(side=F.lit("A"), idx=F.col("l_orderkey"), n=F.col("l_linenumber"))
    return a.add(bag(spark, sf_dir, "orders").map(side=F.lit("B"), idx=F.col("o_orderkey"), n=F.lit(0))).df


@query("SELECT k AS part, n // 6 + CASE WHEN k < n % 6 THEN 1 ELSE 0 END AS n FROM range(6) t(k), (SELECT count(*) AS n FROM lineitem)")
def bag_separate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = bag(spark, sf_dir, "lineitem")
    return x.with_part(6, "l_orderkey", "l_linenumber", "l_partkey").groupBy(F.col("part").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(10 AS BIGINT) AS taken, count(*) - 10 AS remaining FROM lineitem")
def bag_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, rest = bag(spark, sf_dir, "lineitem").remove(10)
    return taken.agg(F.count(F.lit(1)).alias("taken")).join(rest.df.agg(F.count(F.lit(1)).alias("remaining")), F.lit(True))


@query("""
SELECT max(n) AS longest, min(n) AS shortest, CAST(sum(top) AS DOUBLE) AS tops FROM
(SELECT l_suppkey, count(*) AS n, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS top FROM lineitem GROUP BY l_suppkey)""")
def bag_reduce_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = BagFrame(bag(spark, sf_dir, "lineitem").df.withColumnRenamed("l_suppkey", "list_id"))
    per = {"n": F.count(F.lit(1)), "top": F.max(money("l_extendedprice"))}
    return lists.reduce_lists(per, {"longest": F.max("n"), "shortest": F.min("n"), "tops": F.sum("top").cast("double")})


@query("SELECT l_suppkey AS idx, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def scatter_from_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bag(spark, sf_dir, "lineitem").df
    return scatter(rows, (F.col("l_suppkey"), money("l_extendedprice")), total=lambda d: F.sum(d).cast("double"), n=F.count)


@query("""
WITH d AS (SELECT o_custkey AS idx, 1 AS v FROM orders UNION ALL SELECT o_custkey + 1, 2 FROM orders)
SELECT c_custkey, CASE WHEN s IS NULL THEN -1 ELSE s END AS visits FROM customer LEFT JOIN (SELECT idx, CAST(sum(v) AS BIGINT) AS s FROM d GROUP BY idx) ON idx = c_custkey""")
def scatter_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_custkey")
    acc = scatter(orders(spark, sf_dir).df, (key, F.lit(1)), (key + 1, F.lit(2)))
    target = customers(spark, sf_dir).map(visits=F.lit(-1).cast("long"))
    return accept(target, acc, visits=F.col("acc_delta")).df


@query("""
SELECT s_suppkey, CAST(CAST(s_acctbal AS DECIMAL(18,2)) + coalesce((SELECT sum(CAST(b.s_acctbal AS DECIMAL(18,2))) FROM supplier b WHERE b.s_suppkey < a.s_suppkey), 0) AS DOUBLE) AS total
FROM supplier a""")
def accumulate_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each value is sent to all larger indices and added there, over the triangle of pairs."""
    x = suppliers(spark, sf_dir)
    acc = x.combination().scatter_sums(inner=money("l_s_acctbal"))
    total = (money("s_acctbal") + F.coalesce(F.col("acc_delta"), F.lit(0))).cast("double")
    out = accept(x.map(s_acctbal=F.col("s_acctbal"), total=money("s_acctbal").cast("double")), acc, total=total)
    return out.df.select("s_suppkey", "total")
