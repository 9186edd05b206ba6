"""Mixing sources to target weights (1): Pareto order sampling.

Every source gets a target in words. A document is expected ``mu = target / source size`` times: its
``floor(mu)`` whole copies are certain, and one more is drawn. Documents are drawn with unequal inclusion
probabilities: within a band of lengths (a power of two) ``pi`` is the fraction left of ``mu``, times the
document's length over the band's middle length. The draw ranks documents by ``u / (1 - u)`` over
``pi / (1 - pi)`` (random odds by inclusion odds) and takes the lowest until the sample has its fixed
size. That size is fixed in words for each source and band, longest band first; each band makes up for
what the one before took too much or too little, by up to a document of that one. So a source ends
near its target however uneven its documents are, and what is drawn of a band are exactly the
documents with the lowest ranks.

No source is ever ranked in one task. Ranks are whole numbers of ``BITS`` bits. Words are counted in
``2 ** STEP`` steps of a source and band; the few steps that may hold the band's cut, whatever the bands
before leave, are counted again in steps of steps, until so few documents are left (``GATHER`` a source)
that their ranks themselves are looked at. The cut that results is a number that each document compares
with its own rank.

Defined cases: a null text has size 0; documents of size 0 take 0 words; a null source is a source of
its own, last; rows that agree in id, source and size are drawn alike; an empty table gives an empty
result; rows whose
ranks agree are drawn together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.llm.common import hash60, n_words, small_join, stored

BITS, STEP = 50, 10
#: Documents of a source whose ranks a task may look at.
GATHER = 50_000
BANDS = 64
CUTS = "source string, cuts array<long>"
SPANS = "source string, band int, low long, high long, before double, words double, rest double, n long"


def source_targets(sizes: DataFrame, share: float = 1.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all
    words; none gets over ``most`` times its size, and what that leaves is shared by weight again.
    The windows without partitions run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn.cast("int"))
    per = per.withColumn("w", w).withColumn("most", most * F.col("source_size"))
    # Level of water: sources in the order in which a rising level reaches their limits.
    fill = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = share * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    per = per.withColumn("level", level)
    final = F.max(F.when(F.col("level") <= F.col("most") / F.col("w"), F.col("level"))).over(everything)
    target = F.least(F.col("most"), F.coalesce(F.col("w") * final, F.col("most")))
    return per.select("source", "source_size", target.alias("target"))


def _by_band(rows: pd.DataFrame):
    """(band, its rows by key) from the longest documents' band on, with by how much the one before may miss its need."""
    limit = 0.0
    for band in sorted(rows["band"].unique(), reverse=True):
        yield int(band), rows[rows["band"] == band].sort_values("key"), limit
        limit = float(2 << int(band))


def _spans(width: int):
    """For a source: of each band the keys among which its cut lies."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for band, own, limit in _by_band(rows):
            first = own.iloc[0]
            ends = first["before"] + np.cumsum(own["words"].to_numpy(float))
            total = float(first["total"]) if first["total"] >= 0 else float(ends[-1])
            need = total * float(first["rest"])
            # The steps that hold the least and the greatest need.
            a, b = (int(np.clip(np.searchsorted(ends, x), 0, len(own) - 1)) for x in (need - limit, need + limit))
            before = float(first["before"] if a == 0 else ends[a - 1])
            keys = own["key"].to_numpy()
            out.append((key[0], band, int(keys[a]) * width, (int(keys[b]) + 1) * width, before, total, float(first["rest"]), int(own["n"].to_numpy()[a : b + 1].sum())))
        return pd.DataFrame(out, columns=["source", "band", "low", "high", "before", "words", "rest", "n"])

    return run


def _cuts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """For a source: of each band the rank below which documents are drawn."""
    cuts, carry = [0] * BANDS, 0.0
    for band, own, limit in _by_band(rows):
        first = own.iloc[0]
        taken = np.concatenate([[float(first["before"])], first["before"] + np.cumsum(own["size"].to_numpy(float))])
        need = float(first["words"]) * float(first["rest"]) + min(max(carry, -limit), limit)
        k = int(np.argmin(np.abs(taken - need)))
        carry = need - taken[k]
        cuts[band] = int(own["key"].iloc[k - 1]) + 1 if k else int(first["low"])
    return pd.DataFrame({"source": [key[0]], "cuts": [cuts]})


def _rank(df: DataFrame, seed: int, weight: Column | None) -> DataFrame:
    """Adds base, rest, pi, band and key (the Pareto rank) to rows with target, source_size and size."""
    mu = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(mu + 1e-9).cast("int")
    rest = F.greatest(mu - base, F.lit(0.0))
    if weight is None:
        weight = F.col("size") / (F.lit(1.5) * F.expr("shiftleft(1L, band)"))
    pi = F.when(F.col("__rest") > 0, F.greatest(F.least(F.col("__rest") * weight, F.lit(0.999)), F.lit(0.001))).otherwise(0.0)
    drawn = F.shiftright(hash60(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("size")), 8)
    u = (drawn.cast("double") + 0.5) / float(1 << 52)
    odds = (u / (1 - u)) / (F.col("__pi") / (1 - F.col("__pi")))
    return (
        df.withColumn("base", base).withColumn("__rest", rest).withColumn("band", F.length(F.bin("size")) - 1).withColumn("__pi", pi)
        .withColumn("key", F.when(F.col("__pi") > 0, F.least(F.floor(float(1 << BITS) * odds / (1 + odds)), F.lit((1 << BITS) - 1))).otherwise(1 << BITS).cast("long"))
    )


def _cut_ranks(ranked: DataFrame, gather: int) -> DataFrame:
    """(source, cuts) from rows (source, band, key, size, rest) that may be drawn."""
    left, shift = ranked.withColumns({"before": F.lit(0.0), "total": F.lit(-1.0)}), BITS - STEP
    while True:
        steps = left.groupBy("source", "band", F.shiftright("key", shift).alias("key")).agg(
            F.sum("size").cast("double").alias("words"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("rest", "before", "total")]
        )
        spans = stored(steps.groupBy("source").applyInPandas(_spans(1 << shift), SPANS), "spans")
        met = small_join(ranked.drop("rest"), spans, ["source", "band"], F.col("key")).where("key >= low AND key < high")
        most = spans.groupBy("source").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= gather or not shift:
            units = met.groupBy("source", "band", "key").agg(F.sum("size").alias("size"), *[F.first(c).alias(c) for c in ("low", "before", "words", "rest")])
            return units.groupBy("source").applyInPandas(_cuts, CUTS)
        left, shift = met.select("source", "band", "key", "size", "rest", "before", F.col("words").alias("total")), max(shift - STEP, 0)


def draw(sized: DataFrame, sizes: DataFrame, targets: DataFrame, seed: int = 17, weight: Column | None = None, gather: int = GATHER) -> DataFrame:
    """``sized`` (doc_id, source, size, ...) with ``source_size``, ``target`` and ``copies``.

    ``sizes``: a stored table of the same doc_id, source and size, from which the cuts are counted.
    ``weight``: how much likelier than the average of its source a document's extra copy is (default: by
    length, see above; 1: as likely); the cut at the source's target in words makes up for what weights
    change in the expectation.
    """
    own = _rank(small_join(sizes, targets, ["source"], F.col("doc_id")), seed, weight).where("__pi > 0 AND size > 0")
    ranked = stored(own.select("source", "band", "key", "size", F.col("__rest").alias("rest")), "ranked")
    cuts = stored(_cut_ranks(ranked, gather), "cuts")
    chosen = small_join(_rank(small_join(sized, targets, ["source"], F.col("doc_id")), seed, weight), cuts, ["source"], F.col("doc_id"))
    extra = F.coalesce(F.col("key") < F.element_at("cuts", F.col("band") + 1), F.lit(False)).cast("int")
    return chosen.withColumn("copies", F.col("base") + extra).drop("base", "__rest", "__pi", "band", "key", "cuts")


def mix(docs: DataFrame, share: float = 1.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of ``docs`` (doc_id, text, source)."""
    sizes = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    return draw(sizes, sizes, stored(source_targets(sizes, share, weights, most), "targets"), seed)


def mixed(docs: DataFrame, share: float = 1.0, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 17) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken (not at all, or up to ``most`` times).

    Texts aren't shuffled while there are few sources: each row works out its copies where it is read.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row")
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row)
    sizes = stored(sized.select("doc_id", "source", "size"), "sizes")
    taken = draw(sized, sizes, stored(source_targets(sizes, share, weights, most), "targets"), seed).where("copies > 0")
    return taken.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"__row.`{c}`") for c in names])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


OP1_SQL = r"""
WITH RECURSIVE sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 3.0::DOUBLE * sum(size) AS most,
               ([1.0::DOUBLE, 2.0, 3.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM sizes GROUP BY source),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM per),
targets AS (SELECT source, source_size, least(most, coalesce(w * max(CASE WHEN level <= most / w THEN level END) OVER (), most)) AS target FROM levels),
split AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS mu FROM targets),
shares AS (SELECT source, source_size, target, CAST(floor(mu + 1e-9) AS INTEGER) AS base, greatest(mu - floor(mu + 1e-9), 0) AS rest FROM split),
drawn AS (SELECT doc_id, s.source, size, source_size, target, base, rest, length(bin(size)) - 1 AS band,
                 ((CAST('0x' || md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(s.source, '') || '|' || size)[1:15] AS BIGINT) >> 8) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
          FROM sizes s JOIN shares t ON s.source IS NOT DISTINCT FROM t.source),
chances AS (SELECT *, greatest(least(rest * (size / (1.5::DOUBLE * (1::BIGINT << band))), 0.999::DOUBLE), 0.001::DOUBLE) AS pi FROM drawn),
odds AS (SELECT *, (u / (1 - u)) / (pi / (1 - pi)) AS o FROM chances),
ranked AS (SELECT *, CASE WHEN rest > 0 THEN CAST(least(floor(1125899906842624.0::DOUBLE * o / (1 + o)), 1125899906842623) AS BIGINT) ELSE 1125899906842624 END AS bucket FROM odds),
steps AS (SELECT source, band, bucket, any_value(rest) AS rest, CAST(sum(size) AS DOUBLE) AS words FROM ranked WHERE rest > 0 AND size > 0 GROUP BY source, band, bucket),
sums AS (SELECT source, band, bucket, rest, sum(words) OVER (PARTITION BY source, band ORDER BY bucket) AS total FROM steps),
bands AS (SELECT source, band, any_value(rest) AS rest, max(total) AS words, list_concat([0.0::DOUBLE], list(total ORDER BY bucket)) AS taken,
                 list_concat([0], list(bucket + 1 ORDER BY bucket)) AS cuts, row_number() OVER (PARTITION BY source ORDER BY band DESC) AS k FROM sums GROUP BY source, band),
needs AS (
  SELECT source, band, k, taken, cuts, words * rest AS need FROM bands WHERE k = 1
  UNION ALL
  SELECT b.source, b.band, b.k, b.taken, b.cuts,
         b.words * b.rest + greatest(-(2 << n.band), least(2 << n.band, n.need - n.taken[list_position(list_transform(n.taken, lambda x: abs(x - n.need)), list_min(list_transform(n.taken, lambda x: abs(x - n.need))))]))
  FROM needs n JOIN bands b ON b.source IS NOT DISTINCT FROM n.source AND b.k = n.k + 1),
cut AS (SELECT source, band, cuts[list_position(list_transform(taken, lambda x: abs(x - need)), list_min(list_transform(taken, lambda x: abs(x - need))))] AS cut FROM needs)
SELECT doc_id, size, source_size, target, CAST((base + CASE WHEN bucket < cut THEN 1 ELSE 0 END) * size AS BIGINT) AS taken, r.source, base + CASE WHEN bucket < cut THEN 1 ELSE 0 END AS copies
FROM ranked r LEFT JOIN cut c ON r.source IS NOT DISTINCT FROM c.source AND r.band = c.band
"""
