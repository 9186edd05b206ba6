"""Exact dedup (8): a persistent digest index, bucketed and sorted by digest.

New data is reduced to one row per digest, anti-joined to the index by sort-merge (the index side is
read by bucket, without a shuffle) and what is left is appended. Only ids and 32-byte digests are
ever shuffled, never texts.

Defined cases: a null text counts as empty; texts are equal if identical after each run of blanks
became one space; of rows with equal text and equal ``doc_id`` exactly one stays; a null ``doc_id``
stays only if its text has no row with an id; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.common import BLANKS, counted_join, free, freed, new_path, stored

#: Buckets of an index at least, and rows that a bucket is made for.
BUCKETS, BUCKET_ROWS = 64, 4_000_000


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, digest) of every row; ``rid`` tells rows with the same id apart."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), BLANKS, " ")
    return docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.unhex(F.sha2(text, 256)).alias("digest"))


class DigestIndex:
    """Digests seen so far, each with the id of the row that stays.

    The table lies at ``path``; a later session that opens the same path goes on with it.
    """

    COLUMNS = "digest BINARY, keep_id BIGINT, keep_rid BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        jvm = spark.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(there)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Forgets the index and deletes its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        free(self.spark, self.path)

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Deduplicates ``docs`` (doc_id, text) against the index and itself, and appends what is new.

        Returns a row for each row of ``docs``: doc_id, keep_id, group_size (rows of ``docs`` with
        that text), kept, digest. A batch gets a fresh name; one that is given must not be in the index
        yet (ValueError), since rows are told apart within their batch only. Running a batch again
        after a failure before its append is safe, because the append is one commit.
        """
        if batch is None:
            batch = uuid.uuid4().hex
        elif not self.table().where(F.col("batch") == batch).isEmpty():
            raise ValueError(f"batch {batch} is in the index")
        rows = stored(digests(docs), "digests")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid"))
        groups = stored(
            rows.groupBy("digest").agg(first.alias("f"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", F.col("f.doc_id").alias("keep_id"), F.col("f.rid").alias("keep_rid"), "group_size"), "groups",
        )
        new = groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        (
            new.select("digest", "keep_id", "keep_rid", F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        )
        known = self.table().select("digest", "keep_id", F.when(F.col("batch") == batch, F.col("keep_rid")).alias("keep_rid"))
        verdict = groups.select("digest", "group_size").join(known.hint("merge"), "digest")
        total = groups.agg(F.sum("group_size")).first()[0] or 0
        both = counted_join(rows, verdict, "digest", "group_size", total)
        return both.select("doc_id", "v.keep_id", "v.group_size", F.coalesce(F.col("rid") == F.col("v.keep_rid"), F.lit(False)).alias("kept"), "rid", "digest")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """``docs`` against ``index`` (default: a new, empty one with buckets for as many rows, which goes when
    the result is written); see :meth:`DigestIndex.add`."""
    spark, rows = docs.sparkSession, docs.select("doc_id", "text")
    if index is not None:
        return index.add(rows, batch)
    own = DigestIndex(spark, new_path(spark, "index"), max(BUCKETS, -(-docs.count() // BUCKET_ROWS)))
    try:
        with freed(spark) as keep:
            return keep(own.add(rows), "verdict")
    finally:
        own.drop()


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST) = 1 AS kept, h AS text_sha256
FROM d
"""


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all its columns, whatever their names.

    Rows are found again by id and digest; where several rows have both alike, one of them is taken.
    """
    verdict = exact_dedup(docs).select(F.col("doc_id").alias("id"), "digest", "kept")
    alike = verdict.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), BLANKS, " ")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mine = docs.select(F.col("doc_id").alias("own_id"), F.unhex(F.sha2(text, 256)).alias("own"), row)
    stays = verdict.where("kept").select("id", "digest")
    out = mine.join(stays, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("digest")), "left_semi")
    if not alike.isEmpty():
        out = out.dropDuplicates(["own_id", "own"])
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns])
