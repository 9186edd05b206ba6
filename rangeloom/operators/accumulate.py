"""Accumulators: values sent to indices, aggregated there, and taken into a list."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.operators.indexed import IndexedFrame, prefix_sum


def scatter(rows: DataFrame, *deltas: tuple[Column, Column], **aggregates: Callable[[Column], Column]) -> DataFrame:
    """(idx, aggregates): each row sends to index ``deltas[k][0]`` the value ``deltas[k][1]``.

    What a task sends to an index is combined before the shuffle, like a thread's own copy of the
    target; so an index that all rows send to is no burden. Null indices are left out.
    """
    sent = F.array(*[F.struct(i.cast("long").alias("idx"), v.alias("delta")) for i, v in deltas])
    flat = rows.select(F.explode(sent).alias("s")).select("s.idx", "s.delta").where("idx IS NOT NULL")
    made = aggregates or {"delta": F.sum}
    return flat.groupBy("idx").agg(*[f(F.col("delta")).alias(k) for k, f in made.items()])


def accept(target: IndexedFrame, accumulated: DataFrame, **updates: Column) -> IndexedFrame:
    """``target`` with columns updated where something has accumulated; other rows stay as they are."""
    names = [c for c in accumulated.columns if c != "idx"]
    right = accumulated.select(F.col("idx").alias("__i"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"acc_{c}") for c in names])
    met = target.df.join(right, target.df[target.idx] == right["__i"], "left")
    new = {k: F.when(F.col("__hit"), u).otherwise(F.col(k)) if k in target.df.columns else F.when(F.col("__hit"), u) for k, u in updates.items()}
    return IndexedFrame(met.withColumns(new).select(*dict.fromkeys([*target.df.columns, *updates])), target.idx, target._ranges)


__all__ = ["accept", "prefix_sum", "scatter"]
