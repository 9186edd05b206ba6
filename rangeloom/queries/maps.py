"""Maps, logs, row errors and sessions."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions.ranges import LongRange
from rangeloom.operators.indexed import IndexedFrame
from rangeloom.operators.keyed import KeyedFrame, MultiMap, RangedKeyedFrame
from rangeloom.operators.reduce import reduction
from rangeloom.plans import errors
from rangeloom.plans.eventlog import EventLog, activity, worker_activity, write_csv
from rangeloom.plans.schedule import Config, FutureGroup, Session, previous_log, under_session
from rangeloom.queries import money, query
from rangeloom.queries.lists import orders
from rangeloom.sources.scratch import new_path
from rangeloom.sources.tables import bag, table
from rangeloom.streaming.receiver import StreamReceiver


def supplier_map(spark: SparkSession, sf_dir: str) -> KeyedFrame:
    return KeyedFrame(table(spark, sf_dir, "supplier"), "s_suppkey")


@query("""
SELECT c_custkey AS s_suppkey, CASE WHEN s_suppkey IS NULL THEN 'none-' || c_custkey ELSE s_name END AS s_name, coalesce(s_acctbal, 0) AS s_acctbal
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def map_miss_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey"))
    m = supplier_map(spark, sf_dir).set_default(s_name=F.concat(F.lit("none-"), F.col("s_suppkey")), s_acctbal=F.lit(0.0))
    return m.lookup(keys).select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT true AS has_key, false AS has_other, (SELECT coalesce(bool_or(s_nationkey = 3), false) FROM supplier) AS has_value, (SELECT s_name FROM supplier WHERE s_suppkey = 5) AS found, 'none' AS missing")
def map_point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = supplier_map(spark, sf_dir).set_default(s_name=F.lit("none"))
    row = (m.contains_key(5), m.contains_key(-5), m.contains_value("s_nationkey", 3), m.get(5).s_name, m.get(-5).s_name)
    return spark.createDataFrame([row], "has_key boolean, has_other boolean, has_value boolean, found string, missing string")


@query("""
SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 5 = 0 THEN 'new' ELSE s_name END AS s_name FROM supplier WHERE s_suppkey NOT IN (3, 4)
UNION ALL SELECT -1, 0, 'new'""")
def map_put_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = KeyedFrame(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name"), "s_suppkey")
    fresh = m.df.where("s_suppkey % 5 = 0").withColumn("s_name", F.lit("new"))
    return m.put_all(fresh).put(-1, s_nationkey=0, s_name="new").remove(3, 4).df


@query("SELECT s_suppkey, s_nationkey * 2 AS twice FROM supplier")
def map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_map(spark, sf_dir).map(twice=F.col("s_nationkey") * 2).df


@query("SELECT count(*) AS n, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total FROM supplier")
def map_reduce_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_map(spark, sf_dir).reduce(n=F.count(F.lit(1)), total=F.sum(money("s_acctbal")).cast("double"))


def label_map(spark: SparkSession, sf_dir: str) -> RangedKeyedFrame:
    return RangedKeyedFrame(table(spark, sf_dir, "labels"), [LongRange(0, 100), LongRange(100, 250), LongRange(300, 1 << 40)], "doc_id")


@query("SELECT CAST(400 AS BIGINT) AS size, count(*) AS count FROM labels WHERE doc_id < 250 OR (doc_id >= 300 AND doc_id < 450)")
def ranged_map_size_vs_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = label_map(spark, sf_dir).clone_range(LongRange(0, 450))
    return spark.createDataFrame([(m.size(), m.count())], "size long, count long")


@query("SELECT 'removed' AS what, doc_id FROM labels WHERE doc_id >= 100 AND doc_id < 250 UNION ALL SELECT 'left', doc_id FROM labels WHERE doc_id < 100 OR doc_id >= 250")
def ranged_map_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed, left = label_map(spark, sf_dir).remove_range(LongRange(100, 250))
    return removed.select(F.lit("removed").alias("what"), "doc_id").unionByName(left.df.select(F.lit("left").alias("what"), "doc_id"))


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id >= 50 AND doc_id < 320")
def ranged_map_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_map(spark, sf_dir).split(LongRange(50, 320)).df


@query("SELECT i AS key, i * i AS value FROM range(0, 10) t(i) UNION ALL SELECT 20, -1")
def ranged_map_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "key long, value long")
    m = RangedKeyedFrame(none).add_range(LongRange(0, 10), value=F.col("key") * F.col("key")).add_range(LongRange(15, 30))
    return m.put_all(spark.createDataFrame([(20, -1)], "key long, value long")).df


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS types, count(*) AS n FROM events GROUP BY user_id")
def multimap_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = MultiMap(table(spark, sf_dir, "events").select("user_id", "event_type"), "user_id", "event_type")
    return m.grouped().select("user_id", F.array_join("values", ",").alias("types"), F.size("values").cast("long").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(4 AS BIGINT) AS parts FROM supplier")
def map_separate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_map(spark, sf_dir).separate_keys(4).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("part").alias("parts"))


@query("SELECT k AS part, n // 7 + CASE WHEN k < n % 7 THEN 1 ELSE 0 END AS n FROM range(7) t(k), (SELECT count(*) AS n FROM supplier)")
def map_separate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_map(spark, sf_dir).separate_values(7).groupBy(F.col("part").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("n"))


# ---- logs ---------------------------------------------------------------------------------------

DELTA = "CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'purchase' THEN -1 ELSE 0 END"


@query(f"SELECT ts AS time, CAST(sum(sum({DELTA})) OVER (ORDER BY ts) AS BIGINT) AS active FROM events GROUP BY ts")
def log_activity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity(table(spark, sf_dir, "events"), "ts", F.expr(DELTA), width=3_600_000_000)


def event_log(spark: SparkSession, sf_dir: str) -> EventLog:
    e = table(spark, sf_dir, "events")
    return EventLog(e.select((F.col("user_id") % 5).cast("int").alias("place"), F.col("event_type").alias("tag"), (F.col("event_id") % 20).alias("phase"), F.col("event_id").cast("string").alias("msg"), F.col("props").alias("appendix")))


@query("SELECT CAST(user_id % 5 AS INTEGER) AS place, event_type AS tag, event_id % 20 AS phase, count(*) AS items FROM events GROUP BY ALL")
def log_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).keys()


@query("SELECT CAST(event_id AS VARCHAR) AS msg FROM events WHERE user_id % 5 = 2 AND event_type = 'click' AND event_id % 20 = 7")
def log_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).get(2, "click", 7).select("msg")


@query("SELECT CAST(user_id % 5 AS INTEGER) AS place, event_type AS tag, event_id % 20 AS phase, CAST(event_id AS VARCHAR) AS msg, CAST(1 AS BIGINT) AS mine, CAST(0 AS BIGINT) AS theirs FROM events WHERE event_id % 100 = 3")
def log_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    return log.differences(EventLog(log.df.where("cast(msg as long) % 100 != 3"))).drop("appendix")


@query("SELECT * FROM (VALUES (1::BIGINT, 1::BIGINT), (2, 2), (3, 1), (5, 2), (7, 1), (9, 0)) t(time, active)")
def log_worker_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, "worker", 1, "start", "a"), (0, "worker", 2, "start", "b"), (0, "worker", 3, "yield", "a"), (0, "worker", 5, "resume", "a"), (0, "worker", 7, "stop", "b"), (0, "worker", 9, "stop", "a"), (0, "other", 4, "start", "c")]
    return worker_activity(EventLog(spark.createDataFrame(rows, "place int, tag string, phase long, msg string, appendix string")))


# ---- errors and sessions ------------------------------------------------------------------------


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE 1000 // (o_custkey % 10) END AS share, o_custkey % 10 = 0 AS error FROM orders")
def error_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.col("o_custkey") % 10
    return errors.guarded(orders(spark, sf_dir).df.select("o_orderkey", "o_custkey"), by == 0, share=F.floor(F.try_divide(F.lit(1000), by))).drop("o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE 1000 // (o_custkey % 10) END AS share, CASE WHEN o_custkey % 10 = 0 THEN 'ZeroDivisionError' END AS error FROM orders")
def error_captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).df.select("o_orderkey", "o_custkey")
    out = errors.capture(rows, lambda r: {"share": 1000 // (r["o_custkey"] % 10)}, "share long", "o_orderkey")
    return out.withColumn("error", F.substring_index("error", ":", 1))


@query("""
SELECT 1 AS step, 'count' AS name, CAST(count(*) AS BIGINT) AS value FROM orders UNION ALL
SELECT 2, 'top', CAST(max(o_custkey) AS BIGINT) FROM orders UNION ALL SELECT 3, 'both', CAST(count(*) + max(o_custkey) AS BIGINT) FROM orders""")
def session_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = orders(spark, sf_dir)
    with Session(spark, Config(workers=2)) as s:
        count = s.submit(x.size, "count")
        top = s.submit(lambda: x.reduce(m=reduction("max", "o_custkey")).first().m, "top").set_priority(-1)
        both = s.submit(lambda: count.result() + top.result(), "both").after(count).after(top)
        found = FutureGroup.list_results([count, top, both]).result()
    return spark.createDataFrame([(k + 1, n, v) for k, (n, v) in enumerate(zip(("count", "top", "both"), found, strict=True))], "step int, name string, value long")


@query("SELECT o_orderkey, o_custkey + 1 AS next FROM orders")
def session_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Session(spark) as s:
        x = s.submit(lambda: orders(spark, sf_dir).map(next=F.col("o_custkey") + 1), "map")
        made: IndexedFrame = x.result()
    return made.df


@query("""
SELECT 'map' AS what, CAST(sum(o_custkey * 2) AS BIGINT) AS value FROM orders UNION ALL SELECT 'reduce', max(o_custkey) FROM orders
UNION ALL SELECT 'to_bag', CAST(2 * count(*) AS BIGINT) FROM orders UNION ALL SELECT 'errors', count(*) FROM orders WHERE o_custkey % 100 = 0""")
def session_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list's operators as operations of one session: a map, a reduction, a flat map, and one with row errors."""
    x = orders(spark, sf_dir)
    with Session(spark, Config(lifeline="hypercube", grain=50)) as s:
        mapped = s.submit(lambda: x.map(v=F.col("o_custkey") * 2).reduce(v=reduction("sum", "v")).first().v, "map")
        reduced = s.submit(lambda: x.reduce(v=reduction("max", "o_custkey")).first().v, "reduce").after(mapped)
        bagged = s.submit(lambda: x.to_bag(F.array(F.struct("o_orderkey"), F.struct("o_orderkey"))).size(), "to_bag")
        failed = s.submit(lambda: errors.errors(errors.capture(x.df.select("o_orderkey", "o_custkey"), lambda r: {"v": 1 // (r["o_custkey"] % 100)}, "v long", "o_orderkey")).count(), "errors")
        found = [(f.name, f.result()) for f in (mapped, reduced, bagged, failed)]
    return spark.createDataFrame(found, "what string, value long")


@query("SELECT 'list' AS what, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders UNION ALL SELECT 'map', CAST(sum(s_nationkey * 3) AS BIGINT) FROM supplier UNION ALL SELECT 'bag', CAST(sum(l_linenumber) AS BIGINT) FROM lineitem")
def session_for_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side effects as operations of a session, on a list, a map and a bag, so many rows at once."""
    frames = {"list": (orders(spark, sf_dir), lambda r: r.o_custkey), "map": (supplier_map(spark, sf_dir), lambda r: r.s_nationkey * 3), "bag": (bag(spark, sf_dir, "lineitem"), lambda r: r.l_linenumber)}
    seen = {k: spark.sparkContext.accumulator(0) for k in frames}
    with Session(spark, Config(grain=64)) as s:
        for k, (frame, value) in frames.items():
            s.for_each(frame, lambda rows, add=seen[k], value=value: add.add(sum(map(value, rows))), k)
    return spark.createDataFrame([(k, a.value) for k, a in seen.items()], "what string, total long")


@query("SELECT 'kept' AS what, CAST(count(*) AS BIGINT) AS n FROM supplier UNION ALL SELECT 'thrown', 1 UNION ALL SELECT 'logged', 2 UNION ALL SELECT 'cancelled', 1")
def session_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program run under a session: what it threw comes back, staged work that is reset never runs, and the log outlives it."""
    found: dict[str, int] = {}

    def program(s: Session) -> None:
        dropped = s.submit(lambda: found.setdefault("never", 1), "never")
        s.reset()
        found["cancelled"] = int(dropped.cancelled())
        found["kept"] = s.submit(supplier_map(spark, sf_dir).size, "kept").result()
        raise ValueError("the program's own")

    found["thrown"] = len(under_session(spark, program))
    found["logged"] = previous_log(spark).where("tag = 'worker' AND msg IN ('start', 'stop')").count()
    return spark.createDataFrame(list(found.items()), "what string, n long")


@query("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS total FROM events GROUP BY event_type")
def stream_receiver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bag that a stream's batches are appended to."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    source, target = new_path(spark, "stream"), new_path(spark, "received")
    events.write.parquet(source)
    receiver = StreamReceiver(spark, target)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(source)
    receiver.start(stream, new_path(spark, "progress")).awaitTermination()
    return receiver.bag().df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("total"))


@query("SELECT r_regionkey % 2 = 0 AS even, CAST(count(*) AS BIGINT) AS n FROM region GROUP BY 1")
def bag_to_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small bag drained to a list on the driver."""
    even = Counter(r.r_regionkey % 2 == 0 for r in bag(spark, sf_dir, "region").convert_to_list())
    return spark.createDataFrame(list(even.items()), "even boolean, n long")


def nation_log(spark: SparkSession, sf_dir: str) -> EventLog:
    place, phase = F.col("n_regionkey").cast("int"), (F.col("n_nationkey") % 2).cast("long")
    return EventLog(table(spark, sf_dir, "nation").select(place.alias("place"), F.lit("nation").alias("tag"), phase.alias("phase"), F.col("n_name").alias("msg"), F.lit("x").alias("appendix")))


@query("""
WITH n AS (SELECT n_regionkey AS place, n_nationkey % 2 AS phase, n_name AS msg FROM nation),
     l AS (SELECT place, phase, 0 AS kind, '' AS msg, 'place ' || place || ' tag nation phase ' || phase AS line FROM n GROUP BY place, phase UNION ALL SELECT place, phase, 1, msg, '  ' || msg || ' x' FROM n)
SELECT row_number() OVER (ORDER BY place, phase, kind, msg) - 1 AS place, line FROM l""")
def log_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log as it is printed: a line a key in order, and one an item."""
    return spark.createDataFrame(list(enumerate(nation_log(spark, sf_dir).lines())), "place long, line string")


@query("SELECT CAST(n_regionkey AS INTEGER) AS place, 'nation' AS tag, CAST(n_nationkey % 2 AS BIGINT) AS phase, n_name AS msg, 'x' AS appendix, true AS same FROM nation")
def log_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, path = nation_log(spark, sf_dir), new_path(spark, "log")
    log.save(path)
    back = EventLog.load(spark, path)
    return back.df.withColumn("same", F.lit(back.equals(log)))


@query("SELECT * FROM (VALUES ('1', '1'), ('2', '2'), ('3', '1'), ('5', '2'), ('7', '1'), ('9', '0')) t(time, active)")
def log_activity_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of workers at work over time, written as CSV and read back as text."""
    path = new_path(spark, "csv")
    write_csv(log_worker_activity(spark, sf_dir), path)
    return spark.read.option("header", True).csv(path)
