"""Quality rules (10): gradient-boosted trees over document statistics.

Trees are grown on histograms with second-order gradients of the logistic loss; a chosen feature may
be bound to raise or lower the score only: a split against its direction isn't taken, and bounds
handed down keep what lies below from crossing the middle of what lies beside it. Trained trees are flattened
into arrays of nodes (feature, threshold, left, right, value), and a batch is scored by walking all
its rows down a tree together.

``op10`` learns from ``labels.quality`` over a bounded sample (``SAMPLE`` documents a class) and keeps
a document unless the trees find it at most ``KEEP`` likely to be good; a document that fails the
fixed rules is dropped whatever the trees say.

Defined cases: null and empty texts have 0 of everything and fail the rules; without labels of both
kinds the verdict is the rules' alone; labels other than 0 and 1 are ignored; repeated rows are
judged alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.arrow import by_batch
from rangeloom.llm.common import freed, marked, one_text, sampled
from rangeloom.llm.docstats import AT, FEATURES, NAMES, as_batch, features, table

SAMPLE = 5000
TREES, DEPTH, BINS, RATE, SHRINK = 60, 3, 64, 0.15, 1.0
#: Least sum of second-order gradients of a node.
LEAST = 1.0
KEEP = 0.35
#: Features whose growth can only lower the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "bang_share": -1}


@dataclass
class Forest:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: list[int]
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaves that each row of ``x`` reaches; a leaf is its own child."""
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, direction: np.ndarray, trees: int = TREES) -> Forest:
    """Boosted trees for 0/1 labels ``y``; ``direction`` is 1, -1 or 0 by feature."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = min(max(float((y * weight).sum() / weight.sum()), 1e-3), 1 - 1e-3)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots, margin = [], np.full(len(y), np.log(share / (1 - share)))

    def add() -> int:
        k = len(nodes["value"])
        for name, v in (("feature", 0), ("threshold", np.inf), ("left", k), ("right", k), ("value", 0.0)):
            nodes[name].append(v)
        return k

    def split(k: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        mine = float(np.clip(-gs / (hs + SHRINK), low, high))
        best = (1e-6, None)
        if depth < DEPTH:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(bins[rows, j], g[rows], minlength=len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(bins[rows, j], h[rows], minlength=len(c) + 1))[:-1]
                a, b = np.clip(-gl / (hl + SHRINK), low, high), np.clip(-(gs - gl) / (hs - hl + SHRINK), low, high)
                worth = lambda w, p, q: -(p * w + 0.5 * (q + SHRINK) * w * w)
                gain = worth(a, gl, hl) + worth(b, gs - gl, hs - hl) - worth(mine, gs, hs)
                ok = (hl >= LEAST) & (hs - hl >= LEAST) & ((b - a) * direction[j] >= 0)
                gain = np.where(ok, gain, -np.inf)
                if gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (float(gain[i]), (j, i, float(a[i]), float(b[i])))
        if best[1] is None:
            nodes["value"][k] = RATE * mine
            return
        j, i, a, b = best[1]
        middle = (a + b) / 2
        sides = [(low, high), (low, high)]
        if direction[j] > 0:
            sides = [(low, middle), (middle, high)]
        elif direction[j] < 0:
            sides = [(middle, high), (low, middle)]
        nodes["feature"][k], nodes["threshold"][k] = j, float(cuts[j][i])
        goes = bins[rows, j] <= i
        for name, part, (lo, hi) in (("left", rows[goes], sides[0]), ("right", rows[~goes], sides[1])):
            child = add()
            nodes[name][k] = child
            split(child, part, g, h, depth + 1, lo, hi)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        root = add()
        split(root, np.arange(len(y)), weight * (p - y), np.maximum(weight * p * (1 - p), 1e-9), 0, -10.0, 10.0)
        roots.append(root)
        arrays = {k: np.array(v) for k, v in nodes.items()}
        margin += Forest(**arrays, roots=[root], start=0.0).margin(x)
    return Forest(**{k: np.array(v) for k, v in nodes.items()}, roots=roots, start=float(np.log(share / (1 - share))))


def labelled_statistics(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Statistics, label and weight of about ``SAMPLE`` documents a class, one text an id: bounded, so they may come to the driver."""
    with freed(docs.sparkSession):
        return _labelled_statistics(docs.select("doc_id", "text"), marked(labels, "quality", F.lit(False)))


def _labelled_statistics(docs: DataFrame, known: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    chosen = sampled(known, "y", SAMPLE, 10).select("doc_id", "y", "rate")
    rows = one_text(docs.join(F.broadcast(chosen), "doc_id"), "doc_id", "y", "rate")

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = table(batch.column("text").to_pylist())
        return as_batch(batch.column("doc_id"), {"y": batch.column("y").to_numpy(), "rate": batch.column("rate").to_numpy()} | {n: t[:, i] for i, n in enumerate(NAMES)})

    schema = "doc_id long, y int, rate double, " + ", ".join(f"{n} long" for n in NAMES)
    got = by_batch(rows.select(F.col("doc_id").cast("long"), "y", "rate", "text"), of, schema).toPandas().sort_values("doc_id", kind="stable")
    return got[list(NAMES)].to_numpy(np.int64).reshape(len(got), len(NAMES)), got["y"].to_numpy(float), 1 / got["rate"].to_numpy(float)


def fit(docs: DataFrame, labels: DataFrame) -> Forest | None:
    """A forest from ``labels``, or None if one of the kinds is missing."""
    t, y, weight = labelled_statistics(docs, labels)
    if not (y == 0).any() or not (y == 1).any():
        return None
    direction = np.array([MONOTONE.get(n, 0) for n in FEATURES])
    return grow(features(t), y, weight / weight.mean(), direction)


def judge(docs: DataFrame, forest: Forest | None, keep: float = KEEP) -> DataFrame:
    """(doc_id, the statistics, score, base_failed, kept) of each row of ``docs`` (doc_id, text)."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = table(batch.column("text").to_pylist())
        score = forest.probability(features(t)) if forest else np.ones(len(t))
        failed = (t[:, AT["n_words"]] < 20) | (100 * t[:, AT["n_repeat_words"]] > 30 * t[:, AT["n_words"]])
        named = {n: t[:, i] for i, n in enumerate(NAMES)}
        return as_batch(batch.column("doc_id"), named | {"score": score, "base_failed": failed, "kept": ~failed & (score > keep)})

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in NAMES) + ", score double, base_failed boolean, kept boolean"
    return by_batch(docs.select(F.col("doc_id").cast("long"), "text"), of, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = judge(docs, fit(docs, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
