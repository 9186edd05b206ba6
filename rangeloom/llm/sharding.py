"""Sharding (9): proportional stratified interleaving, under the law ``rows``.

Rows of a source are shuffled by a seeded hash and ranked; a row's fractional rank is
``(rank - 1/2) / rows of its source``. Sorted by that, any stretch of rows holds each source in
proportion, and cutting the order into equal stretches makes shards that match the mixture and whose
counts differ by one at most.

Both orders are ranked without a global sort or a task per source: rows are counted by (source, hash
range) and by range of the fractional rank, running sums of those counts give each range its first
position, and rows are numbered within a range only. A hot source is cut into as many hash ranges as
others together need, and the ranges of the fractional rank are even whatever the sources are. Rows that
agree in all columns that count are one row with a number until they are ranked, so not even a row that
makes up a third of the table fills a range.

Equal texts are separate rows here: a group of copies may be larger than a shard, which no law of
equal counts could hold together. Defined cases: a null text has 8 bytes and the crc32 of the empty
text; a null source is a source of its own; repeated rows take neighbouring places; an empty table
gives an empty result; columns besides doc_id, text and source are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.llm.common import hash60, small_join, stored
from rangeloom.operators.repeat import repeated

SHARDS = 24
#: Rows that a task numbers at once.
RANGE_ROWS = 20_000
#: Ranges at least, so that a hot source is spread in small tables too.
LEAST_RANGES = 256


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = 23, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) of each row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    slim = docs.select("doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), crc.alias("text_crc32"))
    shuffled = hash60(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text_crc32"), F.col("size"))
    slim = stored(slim.withColumn("h", shuffled), "slim")
    total = slim.count()
    ranges = max(LEAST_RANGES, -(-total // range_rows))

    # Rank within the source; equal rows take as many ranks.
    slim = slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("m"))
    slim = slim.withColumn("hr", F.shiftright(F.shiftright("h", 28) * ranges, 32).cast("int"))
    counts = slim.groupBy("source", "hr").agg(F.sum("m").alias("n"))
    by = Window.partitionBy("source")
    starts = counts.select(
        "source", "hr", F.sum("n").over(by).alias("of"),
        (F.sum("n").over(by.orderBy("hr").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"),
    )
    own = Window.partitionBy("source", "hr").orderBy("h", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0)
    numbered = slim.withColumn("before", F.sum("m").over(own) - F.col("m"))
    numbered = small_join(numbered, stored(starts, "starts"), ["source", "hr"], F.col("h"), salts=1)
    each = repeated(numbered, "m", "k", range_rows)
    fraction = (F.col("start") + F.col("before") + F.col("k") + 1 - 0.5) / F.col("of")
    ranked = stored(each.select("doc_id", "source", "size", "text_crc32", "h", fraction.alias("fraction")), "ranked")

    # Position in the whole order.
    ranked = ranked.withColumn("fr", F.least(F.floor(F.col("fraction") * ranges), F.lit(ranges - 1)).cast("int"))
    counts = ranked.groupBy("fr").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("fr", (F.sum("n").over(Window.orderBy("fr").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    own = Window.partitionBy("fr").orderBy("fraction", F.col("source").asc_nulls_last(), "h", "doc_id")
    placed = small_join(ranked.withColumn("rn", F.row_number().over(own)), stored(starts, "starts"), ["fr"], F.col("h"), salts=1)
    position = F.col("start") + F.col("rn") - 1
    placed = placed.withColumn("position", position).withColumn("shard", F.expr(f"int(position * {shards} DIV {max(total, 1)})"))
    first = F.expr(f"(shard * {max(total, 1)} + {shards - 1}) DIV {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("position") - first).alias("slot"))


def occurrences(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with ``__n``, which numbers rows that agree in ``by`` from 0 in any order: within the partition they
    are read in, after those of the partitions before. ``df`` must be a table as it is read."""
    parted = df.withColumn("__part", F.spark_partition_id())
    counts = parted.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__rows"))
    again = counts.withColumn("__start", F.sum("__rows").over(Window.partitionBy(*by).orderBy("__part")) - F.col("__rows")).where("__start > 0")
    again = again.select(*[F.col(c).alias(f"__same{k}") for k, c in enumerate(by)], F.col("__part").alias("__of"), "__start")
    own = parted.withColumn("__turn", F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*by)))
    on = (F.col("__part") == F.col("__of")) & reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__same{k}")) for k, c in enumerate(by)])
    met = own.join(again, on, "left").withColumn("__n", F.coalesce("__start", F.lit(0)) + F.col("__turn") - 1)
    return met.select(*df.columns, "__n")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = 23, rows_per_file: int = 1_000_000) -> None:
    """All rows and columns of ``docs`` as Parquet under ``path/shard=k``, in order of their slots.

    Rows are dealt to tasks by ranges of (shard, slot), so that a large shard is written by many tasks,
    and a shard's files hold consecutive slots. Rows alike in id and text share their places in any order.
    """
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    placed = interleave(docs, shards, seed).select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), F.struct("shard", "slot").alias("__at"))
    placed = occurrences(stored(placed, "placed"), "__id", "__crc")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    mine = occurrences(docs.select(F.col("doc_id").alias("__i"), crc.alias("__c"), row), "__i", "__c")
    placed = placed.withColumnRenamed("__n", "__k")
    met = mine.join(placed, mine["__i"].eqNullSafe(placed["__id"]) & (F.col("__c") == F.col("__crc")) & (F.col("__n") == F.col("__k")))
    out = met.select("__row.*", F.col("__at.shard").alias("__shard"), F.col("__at.slot").alias("__slot"))
    out = out.repartitionByRange("__shard", "__slot").sortWithinPartitions("__shard", "__slot")
    names = [F.col(f"`{c}`") for c in docs.columns if c != "shard"]
    out.select(*names, F.col("__shard").alias("shard")).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


OP9_SQL = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
slim AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 8 AS size,
         CAST(xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
                              lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32
  FROM documents, crc_table),
hashed AS (
  SELECT *, CAST('0x' || md5('23|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || text_crc32 || '|' || size)[1:15] AS BIGINT) AS h FROM slim),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY source) AS fraction FROM hashed),
placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, source NULLS LAST, h, doc_id) - 1 AS pos, count(*) OVER () AS n FROM ranked)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(pos * 24 // n AS INTEGER) AS shard,
       CAST(pos - (pos * 24 // n * n + 23) // 24 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM placed
"""
