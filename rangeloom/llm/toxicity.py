"""Toxicity (2): non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text is unlabelled, toxic or not. With the
class prior ``p`` the risk ``p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))`` is
unbiased for what full labels would give, and the maximum keeps it from going below zero: when the
second part does, its gradient is stepped back instead. Labels "not toxic" are used for the prior
alone, unless the prior is given.

Features are words and word beginnings (4 to 7 letters) that positives have more often than
unlabelled text, each with the logarithm of its occurrences; ``CLASSIFIERS`` linear
classifiers, each on its own half of the unlabelled sample, are averaged. Training sees a bounded
sample (``POSITIVES``, ``UNLABELLED`` documents, ``FEATURES`` features); scoring every whole text.

Defined cases: null and empty texts score like a text with no feature; without a positive example
every score is 0; labels other than 0 and 1 are ignored, of several the largest counts; repeated
rows score alike; only doc_id, text and the labels' doc_id and toxic are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.arrow import by_batch, slices
from rangeloom.llm.common import freed, marked, one_text, remainder, spread_of, stored

POSITIVES, UNLABELLED = 4000, 8000
CANDIDATES, FEATURES, CLASSIFIERS = 40_000, 1500, 3
WORDS = re.compile(r"[^\W\d_]+")
SHORT, LONG = 4, 7
#: Words at which an occurrence of a word beginning counts half.
SCALE = 500


def _features(text: str | None, starts: bool = True) -> Iterator[str]:
    """Each different word, and with ``starts`` its beginnings (marked by a star), once a word."""
    for w in set(WORDS.findall((text or "").lower())):
        yield w
        for n in range(SHORT, min(LONG, len(w) - 1) + 1 if starts else 0):
            yield w[:n] + "*"


class Lexicon:
    """The features chosen, looked up by word."""

    def __init__(self, features: list[str], scale: int | None = SCALE):
        self.scale = scale
        self.at = {f: k for k, f in enumerate(features)}
        self.starts = {f[:SHORT] for f in features}
        self.open = {k for k, f in enumerate(features) if f.endswith("*")}

    def values(self, text: str | None) -> dict[int, float]:
        """Value by feature: the logarithm of 1 + its occurrences; of word beginnings, which clean texts
        have by chance the more often the longer they are, those of long texts are scaled down."""
        found: dict[int, int] = {}
        at, starts = self.at, self.starts
        words = WORDS.findall((text or "").lower())
        for w in words:
            if w[:SHORT] in starts:
                for f in (w, *(w[:n] + "*" for n in range(SHORT, min(LONG, len(w) - 1) + 1))):
                    if (k := at.get(f)) is not None:
                        found[k] = found.get(k, 0) + 1
        scale = self.scale / (self.scale + len(words)) if self.scale else 1.0
        return {k: math.log1p(n * scale if k in self.open else n) for k, n in found.items()}


def nnpu(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray, bool]:
    """The risk of weights ``w`` (the last is the bias) over rows of positives and of unlabelled text, the gradient to
    follow, and whether it steps back: where the negatives' part of the risk is below zero the gradient is the
    reverse of that part's alone."""
    zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    mean = lambda x, g: np.append(x.T @ g, g.sum()) / len(x)
    positive, negative = prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    gradient_negative = mean(u, sigmoid(zu)) - prior * mean(p, sigmoid(zp))
    back = bool(negative < 0)
    gradient = -gradient_negative if back else prior * mean(p, sigmoid(zp) - 1) + gradient_negative
    return float(positive + max(0.0, negative)), gradient, back


def fit_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, seed: int, rounds: int = 3000, rate: float = 0.1, decay: float = 1e-5, part: int = 1000) -> np.ndarray:
    """Weights (the last is the bias) of a linear classifier with the logistic loss, by Adam over stretches
    of ``part`` shuffled rows of each kind; the rate falls to a tenth."""
    random = np.random.default_rng(seed)
    xp, xu = (np.ascontiguousarray(x[random.permutation(len(x))], np.float32) for x in (xp, xu))
    w, first, second = np.zeros((3, xp.shape[1] + 1), np.float32)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, rounds + 1):
        p, u = (x[(at := random.integers(max(1, len(x) - part + 1))) : at + part] for x in (xp, xu))
        gradient = nnpu(w, p, u, prior)[1]
        gradient[:-1] += decay * w[:-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        speed = rate * (1 - 0.9 * step / rounds)
        w -= speed * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w.astype(float)


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(texts))
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            found = self.lexicon.values(t)
            z = self.weights[:, -1]
            if found:
                z = z + self.weights[:, list(found)] @ np.fromiter(found.values(), float)
            out[i] = (1 / (1 + np.exp(-z))).mean()
        return out


def _count(batches: Iterable[pa.RecordBatch], only: set[str] | None = None, starts: bool = True) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n: Counter[str] = Counter()
        for t in batch.column("text").to_pylist():
            n.update(f for f in _features(t, starts) if only is None or f in only)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["f", "n"])


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, most: int = FEATURES, scale: int | None = SCALE, starts: bool = True) -> Model:
    """A model from rows that aren't held out; on the driver only features of the samples, one text an id."""
    with freed(docs.sparkSession):
        return _fit(docs.where(~held_out).select("doc_id", "text"), marked(labels, "toxic", held_out), prior, positives, unlabelled, most, scale, starts)


def toxic_sample(open_: DataFrame, known: DataFrame, n_toxic: int, positives: int, unlabelled: int) -> DataFrame:
    """(doc_id, p, u, text): about ``positives`` documents marked toxic (p) and ``unlabelled`` of all (u), chosen by
    the hash of the id, one text an id."""
    # About ``positives`` ids: a broadcast of a bounded size.
    chosen = known.where((F.col("y") == 1) & (spread_of(F.lit(2), "doc_id") < positives / n_toxic)).select("doc_id", F.lit(True).alias("p"))
    total = open_.agg(F.approx_count_distinct("doc_id", 0.02)).first()[0]
    met = open_.join(F.broadcast(chosen), "doc_id", "left").withColumn("p", F.coalesce("p", F.lit(False)))
    met = met.withColumn("u", spread_of(F.lit(3), "doc_id") < unlabelled / max(total, 1))
    return one_text(met.where("p OR u").select("doc_id", "p", "u", "text"), "doc_id", "p", "u")


def _fit(open_: DataFrame, known: DataFrame, prior: float | None, positives: int, unlabelled: int, most: int, scale: int | None, starts: bool) -> Model:
    n, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n_toxic:
        return Model(Lexicon([]), np.zeros((0, 1)))
    prior = min(max(prior if prior is not None else n_toxic / n, 1e-3), 0.9)
    texts = stored(toxic_sample(open_, known, n_toxic, positives, unlabelled), "toxic_sample")
    frequent = texts.where("p").select("text").mapInArrow(lambda b: _count(b, None, starts), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    of_p = {r.f: r.n for r in frequent.where("n >= 3").orderBy(F.desc("n"), "f").limit(CANDIDATES).collect()}
    only = set(of_p)
    in_u = texts.where("u").select("text").mapInArrow(lambda b: _count(b, only), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))
    of_u = {r.f: r.n for r in in_u.collect()}
    np_, nu = texts.agg(F.sum(F.col("p").cast("int")), F.sum(F.col("u").cast("int"))).first()
    if not np_ or not nu:
        return Model(Lexicon([]), np.zeros((0, 1)))

    def lift(f: str) -> float:
        a, b = of_p[f] / np_, of_u.get(f, 0) / nu
        return (a - b) / np.sqrt((a + b) * (1 / np_ + 1 / nu))

    features = sorted((f for f in only if lift(f) > 3), key=lambda f: (-lift(f), f))[:most]
    lexicon = Lexicon(features, scale)

    def sparse(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [lexicon.values(t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("p"), batch.column("u"), pa.array([list(x) for x in found], pa.list_(pa.int32())), pa.array([list(x.values()) for x in found], pa.list_(pa.float64()))],
            ["doc_id", "p", "u", "k", "v"],
        )

    rows = by_batch(texts.select(F.col("doc_id").cast("long"), "p", "u", "text"), sparse, "doc_id long, p boolean, u boolean, k array<int>, v array<double>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, (k, c) in enumerate(zip(rows["k"], rows["v"], strict=True)):
        x[i, np.asarray(k, int)] = np.asarray(c, float)
    xp, xu = x[rows["p"].to_numpy()], x[rows["u"].to_numpy()]
    weights = []
    for k in range(CLASSIFIERS):
        half = np.random.default_rng(k).random(len(xu)) < 0.5
        weights.append(fit_nnpu(xp, xu[half] if half.any() else xu, prior, k))
    return Model(lexicon, np.stack(weights))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES features

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held.value.score(batch.column("text").to_pylist()))], ["doc_id", "score"])

    return by_batch(docs.select(F.col("doc_id").cast("long"), "text"), of, "doc_id long, score double")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = remainder(F.col("doc_id"), 5) == 0
    out = score(docs, fit(docs, labels, held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
