"""Quality classifier (5): a factorisation machine.

Inputs of a document are its hashed words (logarithm of the count, scaled to length 1), structure
statistics and the metadatum ``n_chars``, each cut into ranges with an input of its own. Besides a
weight each input has ``RANK`` factors, and the score adds the dot product of each pair's factors:
``1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)``, which is linear in the inputs present.

Learnt with the logistic loss by Adagrad over a bounded sample (``SAMPLE`` labelled documents a
class, weighted back to all) and applied to every whole text.

Defined cases: null and empty texts have no words, and statistics of 0; a null ``n_chars`` is a range
of its own; with labels of one kind only every score is that kind's, without any 1/2; labels other than 0 and 1 are ignored, of several the largest counts; repeated rows score
alike; columns besides doc_id, text and n_chars are ignored.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.arrow import by_batch, pieces
from rangeloom.llm.common import freed, marked, one_text, remainder, sampled
from rangeloom.llm.docstats import AT, FEATURES, features, table

SAMPLE = 4000
WORDS, RANK, RANGES = 1 << 14, 8, 16
#: At least EPOCHS passes and STEPS batches.
EPOCHS, STEPS, BATCH, RATE, DECAY = 6, 800, 64, 0.16, 1e-5
#: Inputs: words, ranges of each statistic, ranges of n_chars (the first for null), ranges of how far it is from the text.
CHARS, APART = 24, 8
INPUTS = WORDS + RANGES * len(FEATURES) + CHARS + APART


def word_inputs(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    found = Counter((text or "").encode("utf-8", "surrogatepass").lower().split())
    ids = np.fromiter((crc32(w) & (WORDS - 1) for w in found), np.int64, len(found))
    values = np.log1p(np.fromiter(found.values(), float, len(found)))
    return ids, values / max(np.sqrt((values * values).sum()), 1e-9)


def metadata_inputs(n_chars: list[int | None], t: np.ndarray) -> np.ndarray:
    """Two input numbers a row."""
    given = np.array([-1 if n is None else max(0, n) for n in n_chars], float)
    size = np.where(given < 0, 0, 1 + np.minimum(np.log2(given.clip(0) + 1).astype(int), CHARS - 2))
    apart = np.where(given < 0, 0, np.minimum(np.log2(np.abs(given - t[:, AT["n_chars"]]) + 1).astype(int), APART - 1))
    first = WORDS + RANGES * len(FEATURES)
    return np.stack([first + size, first + CHARS + apart], axis=1).astype(np.int64)


def joined(texts: list[str | None], n_chars: list[int | None], cuts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, input, value) of all inputs of a batch, and the rows' statistics; no statistics inputs without ``cuts``."""
    words = [word_inputs(t) for t in texts]
    sizes = [len(i) for i, _ in words]
    row = np.repeat(np.arange(len(texts)), sizes)
    t = table(texts)
    x = features(t)
    more = metadata_inputs(n_chars, t)
    if cuts is not None:
        ranges = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)
        more = np.concatenate([more, WORDS + RANGES * np.arange(len(FEATURES)) + ranges], axis=1)
    ids = np.concatenate([*(i for i, _ in words), more.ravel()])
    values = np.concatenate([*(v for _, v in words), np.full(more.size, 0.5)])
    return np.concatenate([row, np.repeat(np.arange(len(texts)), more.shape[1])]), ids, values, x


class Machine:
    def __init__(self, seed: int = 5):
        random = np.random.default_rng(seed)
        self.bias, self.w, self.v = 0.0, np.zeros(INPUTS), random.normal(0, 0.02, (INPUTS, RANK))
        self.cuts = np.zeros((len(FEATURES), RANGES - 1))

    def sums(self, row: np.ndarray, ids: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Margin by row, sum of factors by row, and each input's factors times its value."""
        vx = self.v[ids] * x[:, None]
        s = np.stack([np.bincount(row, vx[:, f], n) for f in range(RANK)], axis=1)
        squares = np.bincount(row, (vx * vx).sum(axis=1), n)
        return self.bias + np.bincount(row, self.w[ids] * x, n) + 0.5 * ((s * s).sum(axis=1) - squares), s, vx

    def fit(self, starts: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, steps: int = STEPS, rate: float = RATE) -> None:
        share = min(max(float((y * weight).sum() / weight.sum()), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        past_w, past_v, past_b = np.full(INPUTS, 1e-3), np.full((INPUTS, RANK), 1e-3), 1e-3
        random = np.random.default_rng(1)
        for _ in range(max(epochs, -(-steps * BATCH // len(y)))):
            order = random.permutation(len(y))
            for at in range(0, len(y), BATCH):
                own = order[at : at + BATCH]
                sizes = starts[own + 1] - starts[own]
                where = np.repeat(starts[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                row, i, v = np.repeat(np.arange(len(own)), sizes), ids[where], x[where]
                margin, s, vx = self.sums(row, i, v, len(own))
                g = weight[own] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[own]) / len(own)
                used, which = np.unique(i, return_inverse=True)
                gx = g[row] * v
                gw = np.bincount(which, gx, len(used)) + DECAY * self.w[used]
                gv = np.stack([np.bincount(which, gx * (s[row, f] - vx[:, f]), len(used)) for f in range(RANK)], axis=1) + DECAY * self.v[used]
                past_w[used] += gw * gw
                past_v[used] += gv * gv
                past_b += g.sum() ** 2
                self.w[used] -= rate * gw / np.sqrt(past_w[used])
                self.v[used] -= rate * gv / np.sqrt(past_v[used])
                self.bias -= rate * g.sum() / np.sqrt(past_b)

    def score(self, texts: list[str | None], n_chars: list[int | None]) -> np.ndarray:
        return np.concatenate([self._score(texts[p], n_chars[p]) for p in pieces(texts)])

    def _score(self, texts: list[str | None], n_chars: list[int | None]) -> np.ndarray:
        row, ids, x, _ = joined(texts, n_chars, self.cuts)
        return 1 / (1 + np.exp(-np.clip(self.sums(row, ids, x, len(texts))[0], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, **settings) -> Machine:
    """A machine from rows that aren't held out; the sample's inputs come to the driver, bounded by ``SAMPLE``, one
    text an id. ``settings``: of :meth:`Machine.fit`."""
    with freed(docs.sparkSession):
        return learnt(inputs_of(docs.where(~held_out).select("doc_id", "text", "n_chars"), marked(labels, "quality", held_out)), **settings)


def inputs_of(open_: DataFrame, known: DataFrame) -> pd.DataFrame:
    """(doc_id, y, rate, i, v, x): inputs and statistics of the sample's documents."""
    chosen = sampled(known, "y", SAMPLE, 9).select("doc_id", "y", "rate")
    rows = one_text(open_.join(F.broadcast(chosen), "doc_id"), "doc_id", "y", "rate")

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [inputs(batch.slice(p.start, p.stop - p.start)) for p in pieces(batch.column("text").to_pylist())]
        return pa.Table.from_batches(made).combine_chunks().to_batches()[0]

    def inputs(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        row, ids, values, x = joined(texts, batch.column("n_chars").to_pylist(), None)
        order = np.argsort(row, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32)
        lists = lambda a: pa.ListArray.from_arrays(pa.array(ends), pa.array(a[order]))
        stats = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("rate"), lists(ids.astype(np.int32)), lists(values.astype(np.float32)), stats], ["doc_id", "y", "rate", "i", "v", "x"])

    got = by_batch(rows.select(F.col("doc_id").cast("long"), "y", "rate", "text", F.col("n_chars").cast("long")), of, "doc_id long, y int, rate double, i array<int>, v array<float>, x array<double>")
    return got.toPandas().sort_values("doc_id", kind="stable")


def learnt(got: pd.DataFrame, **settings) -> Machine:
    out = Machine()
    y = got["y"].to_numpy(float)
    if len(set(y)) < 2:
        out.v[:] = 0
        out.bias = (30.0 if y[0] else -30.0) if len(y) else 0.0
        return out
    x = np.stack(got["x"].to_list())
    out.cuts = np.quantile(x, np.linspace(0, 1, RANGES + 1)[1:-1], axis=0).T
    ranges = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(out.cuts)], axis=1) + WORDS + RANGES * np.arange(len(FEATURES))
    ids = [np.concatenate([np.asarray(i, np.int64), r]) for i, r in zip(got["i"], ranges, strict=True)]
    values = [np.concatenate([np.asarray(v, float), np.full(len(FEATURES), 0.5)]) for v in got["v"]]
    weight = 1 / got["rate"].to_numpy(float)
    out.fit(np.concatenate([[0], np.cumsum([len(i) for i in ids])]), np.concatenate(ids), np.concatenate(values), y, weight / weight.mean(), **settings)
    return out


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of each row of ``docs`` (doc_id, text, n_chars)."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # INPUTS * (RANK + 1) numbers

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = held.value.score(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made)], ["doc_id", "score"])

    return by_batch(docs.select(F.col("doc_id").cast("long"), "text", F.col("n_chars").cast("long")), of, "doc_id long, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = remainder(F.col("doc_id"), 4) == 2
    out = score(docs, fit(docs, labels, held_out))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
