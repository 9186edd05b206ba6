"""What the operators share: the shared folder, tables written to it, word rules, small-table joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.sources.scratch import new_path

#: A word is a run of anything but these six characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"

#: A small side of at most so many rows may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: computed once, lineage cut,
    and still readable when an executor is lost. See :func:`freed` for when it goes."""
    spark = df.sparkSession
    path = new_path(spark, name)
    for own in _SCRATCH:
        own.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def free(spark: SparkSession, *paths: str) -> None:
    """Deletes tables in the shared folder."""
    for path in paths:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


#: Paths that the blocks of :func:`freed` now open have seen, innermost last.
_SCRATCH: list[list[str]] = []


@contextmanager
def freed(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose stored tables go at its end, but for those made by the function it gives, which is
    :func:`stored` for results. Only results may be used after the block; if it fails all tables stay
    until the application ends."""
    kept: set[str] = set()

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        kept.add(out.stored_at)
        return out

    _SCRATCH.append(mine := [])
    try:
        yield keep
    finally:
        _SCRATCH.pop()
    free(spark, *[p for p in mine if p not in kept])


#: A key with at least this share of the rows counts as hot; there can't be more than 1 / HOT of them.
HOT = 1 / 4096


def counted_join(rows: DataFrame, values: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` with the struct ``v`` of the other columns of ``values``: one row a key, whose column
    ``n`` counts the key's ``rows``, of which there are ``total``.

    Rows of hot keys stay where they are and get their values by broadcast, of at most 1 / ``HOT``
    rows whatever the input; the others are joined by shuffle, where no key is large.
    """
    hot = F.col(n) >= max(2.0, total * HOT)
    v = F.struct(*[c for c in values.columns if c != key])
    met = rows.join(F.broadcast(values.where(hot).select(key, v.alias("__h"))), key, "left")
    cool = met.where("__h IS NULL").drop("__h").join(values.where(~hot).select(key, v.alias("v")), key)
    return cool.unionByName(met.where("__h IS NOT NULL").withColumnRenamed("__h", "v"))


def hash60(*parts: Column) -> Column:
    """A hash of 60 bits of the parts as text, which SQL engines agree on; nulls count as empty."""
    line = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def small_join(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, salts: int = 32) -> DataFrame:
    """Left join of ``big`` to a small table on ``keys`` (compared null-safe).

    ``small`` is broadcast if a count shows at most ``BROADCAST_ROWS`` rows. Beyond that each of its
    rows is repeated for ``salts`` values and both sides are shuffled by key and salt, so that a key
    with a third of all rows is spread over ``salts`` tasks (1: no key is large). ``spread``: what
    picks a row's salt.
    """
    right = small
    for k in keys:
        right = right.withColumnRenamed(k, f"__r_{k}")
    on = [big[k].eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        out = big.join(F.broadcast(right), on, "left")
    elif salts == 1:
        out = big.join(right, on, "left")
    else:
        left = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
        right = right.withColumn("__r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on = [left[k].eqNullSafe(F.col(f"__r_{k}")) for k in keys] + [F.col("__salt") == F.col("__r_salt")]
        out = left.join(right, on, "left").drop("__salt", "__r_salt")
    return out.drop(*[f"__r_{k}" for k in keys])


def spread_of(*cols: Column | str) -> Column:
    """A number in [0, 1) that only the row's values decide; for samples that come out alike on each run."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)).cast("double") / float(1 << 40)


def one_text(rows: DataFrame, *by: str) -> DataFrame:
    """One row for each value of ``by``, with the smallest of its other columns' values (text first); combined
    before the shuffle, so that an id on very many rows is no burden to a task or to who collects the result."""
    rest = sorted((c for c in rows.columns if c not in by), key=lambda c: (c != "text", c))
    return rows.groupBy(*by).agg(F.min(F.struct(*rest)).alias("r")).select(*by, *[F.col(f"r.{c}").alias(c) for c in rest])


def sampled(rows: DataFrame, by: str, most: int, seed: int) -> DataFrame:
    """About ``most`` ids of each value of ``by`` (all if there are fewer), with ``rate``, the share kept.

    A bounded sample to fit a classifier on. Ids are chosen by their hash, so no value's rows meet in a
    task, and ids are counted, not rows; callers take one row an id (:func:`one_text`).
    """
    rates = rows.groupBy(by).agg(F.least(F.lit(1.0), most / F.greatest(F.approx_count_distinct("doc_id", 0.02), F.lit(1))).alias("rate"))
    met = small_join(rows, stored(rates, "rates"), [by], F.col("doc_id"))
    return met.where(spread_of(F.lit(seed), "doc_id") < F.col("rate"))


def marked(labels: DataFrame, name: str, held_out: Column) -> DataFrame:
    """(doc_id, y): one 0/1 label a document, without held-out documents; of several labels the largest
    counts, nulls and other values don't."""
    y = F.col(name).cast("int")
    return labels.where(~held_out & F.col("doc_id").isNotNull() & y.isin(0, 1)).groupBy("doc_id").agg(F.max(y).alias("y"))
