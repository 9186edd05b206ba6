"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.llm.common import stored


def _hung(edges: DataFrame, largest_only: bool) -> DataFrame:
    """Each node's neighbours hung on its smallest one: the larger ones (``largest_only``) or, for
    links that lead to smaller nodes, all of them and the node itself."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    met = edges.join(least, "u")
    if largest_only:
        return met.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    return met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one link at most, and those that links lead to have none: one pass over the links."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (u, v) that isn't the smallest of its component.

    Each round hangs every node's larger neighbours on its smallest one, then its smaller neighbours
    on the smallest of them, and halves at least the depth of what isn't a star yet; rounds grow with
    the logarithm of the longest chain. Node sides of the joins are one row a node, and rows of a
    node with very many links may be split over tasks. Each round is a table in the shared folder.
    """
    ordered = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = stored(ordered.distinct(), "links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = stored(_hung(_hung(both, True).distinct(), False).distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
