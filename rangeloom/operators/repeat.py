"""Rows that stand for several equal ones, as many rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task makes of one, and parts that larger numbers are spread over.
BLOCK, SPREAD = 20_000, 256


def repeated(df: DataFrame, times: str, at: str, block: int = BLOCK) -> DataFrame:
    """Each row as often as its column ``times`` says, numbered from 0 in the column ``at``. A row that stands
    for more than ``block`` is cut into blocks first, which are spread over tasks."""
    n = F.col(times)
    few = df.where(n <= block).withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    many = df.where(n > block).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{times}` - 1) DIV {block}"))))
    many = many.repartition(SPREAD, "__part", F.xxhash64(*df.columns))
    stop = F.least(n, (F.col("__part") + 1) * block) - 1
    return few.unionByName(many.withColumn(at, F.explode(F.sequence(F.col("__part") * block, stop))).drop("__part"))
