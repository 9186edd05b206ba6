"""Event logs: rows (place, tag, phase, msg, appendix), several a key (place, tag, phase)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["place", "tag", "phase"]
ITEM = ["msg", "appendix"]


class EventLog:
    def __init__(self, df: DataFrame):
        self.df = df.select(*KEY, *ITEM)

    def put(self, rows: DataFrame) -> EventLog:
        return EventLog(self.df.unionByName(rows.select(*KEY, *ITEM)))

    gather = put

    def get(self, place: int, tag: str, phase: int) -> DataFrame:
        """The items (msg, appendix) of a key."""
        return self.df.where((F.col("place") == place) & F.col("tag").eqNullSafe(F.lit(tag)) & (F.col("phase") == phase)).select(*ITEM)

    def keys(self) -> DataFrame:
        return self.df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("items"))

    def place_count(self) -> int:
        return self.df.select("place").distinct().count()

    def ordered(self) -> DataFrame:
        """By place (as an unsigned number), tag and phase."""
        unsigned = F.when(F.col("place") < 0, F.col("place").cast("long") + (1 << 32)).otherwise(F.col("place").cast("long"))
        return self.df.orderBy(unsigned, "tag", "phase", *ITEM)

    def lines(self) -> Iterator[str]:
        """What a print-out has: a line a key, and one an item."""
        last = None
        for r in self.ordered().toLocalIterator():
            key = (r.place, r.tag, r.phase)
            if key != last:
                yield f"place {r.place} tag {r.tag} phase {r.phase}"
                last = key
            yield f"  {r.msg} {r.appendix}"

    def differences(self, other: EventLog) -> DataFrame:
        """(place, tag, phase, msg, appendix, mine, theirs): items that the logs hold a different number of times."""
        counted = lambda log, name: log.df.groupBy(*KEY, *ITEM).agg(F.count(F.lit(1)).alias(name))
        both = counted(self, "mine").withColumn("theirs", F.lit(0).cast("long")).unionByName(counted(other, "theirs").withColumn("mine", F.lit(0).cast("long")))
        met = both.groupBy(*KEY, *ITEM).agg(F.sum("mine").alias("mine"), F.sum("theirs").alias("theirs"))
        return met.where("mine != theirs")

    def equals(self, other: EventLog) -> bool:
        return self.differences(other).isEmpty()

    def save(self, path: str) -> None:
        self.df.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EventLog:
        return cls(spark.read.parquet(path))


def activity(events: DataFrame, time: str, delta: Column, width: int | None = None) -> DataFrame:
    """(time, active): how many are active after each time, from events that start (+1) or stop (-1) them.

    Deltas are summed by time first. With ``width`` the running sum is in two levels, over blocks of
    so many time units and inside them; without it the (much fewer) times are scanned at once.
    """
    sums = events.groupBy(F.col(time).alias("time")).agg(F.sum(delta).cast("long").alias("d"))
    if width is None:
        return sums.select("time", F.sum("d").over(Window.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)).alias("active"))
    from rangeloom.operators.indexed import prefix_sum

    return prefix_sum(sums.withColumn("t", F.unix_micros(F.col("time").cast("timestamp")) if dict(sums.dtypes)["time"].startswith("timestamp") else F.col("time")), "t", F.col("d"), "active", width).select("time", "active")


#: What worker events do to the number of workers at work. Each is a case of its own.
WORKER_DELTA = {"start": 1, "resume": 1, "yield": -1, "stop": -1}


def worker_activity(log: EventLog, tag: str = "worker") -> DataFrame:
    """(time, active) from a session's log; the phase is the time."""
    msg = F.col("msg")
    delta = F.lit(0)
    for name, d in WORKER_DELTA.items():
        delta = F.when(msg == name, F.lit(d)).otherwise(delta)
    return activity(log.df.where(F.col("tag") == tag), "phase", delta)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def printed(rows: list[Row]) -> str:
    return "\n".join(", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows)
