"""Sessions, futures, row errors, logs and receivers."""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from rangeloom.plans import errors
from rangeloom.plans.eventlog import EventLog, worker_activity, write_csv
from rangeloom.plans.schedule import Config, FutureGroup, ParallelError, Session, lifelines, previous_log, run_async, under_session
from rangeloom.streaming.receiver import StreamReceiver


def test_order_dependencies_priority(spark):
    ran: list[str] = []
    with Session(spark, Config(workers=1)) as s:
        a = s.submit(lambda: ran.append("a"), "a")
        b = s.submit(lambda: ran.append("b"), "b").set_priority(-5)
        c = s.submit(lambda: ran.append("c") or spark.range(10).count(), "c").after(a)
        d = s.submit(lambda: ran.append("d"), "d").set_priority(-5)
        assert c.result() == 10 and a.done() and c.after(a) is c
        with pytest.raises(RuntimeError):
            c.set_priority(1)
    assert ran == ["b", "d", "a", "c"] and d.done()
    assert previous_log(spark).where("tag = 'worker'").count() == 8
    assert worker_activity(EventLog(previous_log(spark))).agg(F.max("active")).first()[0] == 1


def test_one_session_errors_and_cycles(spark):
    with Session(spark) as s:
        with pytest.raises(RuntimeError):
            Session(spark).__enter__()
        a, b = s.submit(lambda: 1), s.submit(lambda: 1 / 0)
        b.after(a)
        with pytest.raises(ValueError):
            a.after(b)
        assert [type(e) for e in b.errors()] == [ZeroDivisionError]
        with pytest.raises(ParallelError):
            b.result()
        c = s.submit(lambda: 3)
        assert c.cancel() and c.cancelled()
    assert [type(e) for e in under_session(spark, lambda s: 1 / 0)] == [ZeroDivisionError]


def test_future_groups():
    with ThreadPoolExecutor(3) as pool:
        f = [pool.submit(lambda k=k: k) for k in range(3)]
        got: list[int] = []
        assert FutureGroup.list_results(f).result() == [0, 1, 2] and FutureGroup.only_wait(f).result() is None
        FutureGroup.consume_results(f, got.append).result()
        assert got == [0, 1, 2] and FutureGroup.return_given(f, "x").result() == "x" and FutureGroup.only_wait(f).done()
        stop = threading.Event()
        slow = FutureGroup.only_wait([pool.submit(stop.wait)])
        with pytest.raises(TimeoutError):
            slow.result(timeout=0.05)
        stop.set()
        with pytest.raises(ParallelError) as e:
            run_async(pool, lambda: 1 / 0, lambda: int("x"), lambda: 2).result()
        assert len(e.value.errors) == 2


def test_settings(spark):
    spark.conf.set("spark.rangeloom.grain", "7")
    spark.conf.set("spark.rangeloom.trace", "true")
    assert Config.of(spark) == Config(grain=7, trace=True)
    spark.conf.unset("spark.rangeloom.grain")
    spark.conf.unset("spark.rangeloom.trace")
    assert Config.of(spark) == Config()


def test_lifelines():
    assert lifelines("loop", 3, 4) == [0] and lifelines("none", 0, 4) == []
    assert lifelines("hypercube", 0, 6) == [1, 2, 4] and lifelines("hypercube", 3, 6) == [2, 1]


def test_errors_by_index(spark):
    df = spark.createDataFrame([(i, None if i in (5, 150) else f"s{i}") for i in range(340)], "idx long, s string").repartition(4)
    out = errors.capture(df, lambda r: {"n": len(r["s"])}, "n int")
    assert sorted(r.idx for r in errors.errors(out).collect()) == [5, 150]
    assert errors.results(out).count() == 338
    safe = errors.guarded(df, F.col("s").isNull(), n=F.length("s"))
    assert safe.where("error").count() == 2 and errors.results(safe).count() == 338


def test_logs(spark, tmp_path):
    rows = [(0, "a", 1, "x", "1"), (0, "a", 1, "x", "1"), (-1, "b", 2, "y", None), (1, None, 0, "z", "")]
    log = EventLog(spark.createDataFrame(rows, "place int, tag string, phase long, msg string, appendix string"))
    log.save(str(tmp_path / "log"))
    again = EventLog.load(spark, str(tmp_path / "log"))
    assert log.equals(again) and log.place_count() == 3 and log.get(0, "a", 1).count() == 2
    assert [r.place for r in log.ordered().collect()] == [0, 0, 1, -1]
    fewer = EventLog(spark.createDataFrame(rows[1:], log.df.schema))
    assert [(r.msg, r.mine, r.theirs) for r in log.differences(fewer).collect()] == [("x", 2, 1)]
    assert next(iter(log.lines())) == "place 0 tag a phase 1"
    write_csv(log.keys(), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3


def test_receiver(spark, tmp_path):
    spark.range(0, 50).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    receiver = StreamReceiver(spark, str(tmp_path / "out"))
    double = lambda df: df.select(F.explode(F.array("id", F.col("id") + 100)).alias("v"))
    receiver.start(stream, str(tmp_path / "ck"), double).awaitTermination(60)
    receiver.accept(spark.range(3).select(F.col("id").alias("v")), 7)
    receiver.accept(spark.range(3).select(F.col("id").alias("v")), 7)
    assert receiver.bag().size() == 103
