"""Language ID (4): interpolated Kneser-Ney character models, one a language.

Texts become lower-case letters with single spaces for all else. For each language all 4-grams of a
bounded sample (about ``SAMPLE`` documents and ``CHARS`` characters) give an interpolated Kneser-Ney
model: absolute discounts, continuation counts at the lower orders, a uniform floor. Each language's
model is made by a task of its own and kept in sorted arrays of hashed n-grams (multiplication by an odd
number, so hashes don't collide); the driver sees these arrays only, whose size grows with the number of
languages. A batch's different 4-grams are looked up once a language.

The language with the lowest cross-entropy a character wins. A text is rejected if it has no letter
or if that cross-entropy is further above what the language's own texts have than length and spread
of the calibration texts (a part of the sample that the counts don't see) explain.

Defined cases: null, empty and letterless texts are ``und`` with score 0; with no training text all
texts are ``und``; equal cross-entropies go to the first language by code point; rows with a null
``lang`` or in the held-out fold aren't learnt from; other columns are ignored.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm.arrow import by_batch, pieces, slices
from rangeloom.llm.common import freed, one_text, remainder, small_join, spread_of, stored

SAMPLE, CHARS = 2000, 20_000_000
CALIBRATION = 0.2
#: Standard deviations above the mean, and nats besides, at which a text is rejected.
SIGMAS, SLACK = 2.0, 1.0
MIX = np.uint64(0x9E3779B97F4A7C15)
SPACE = 32


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> lower-case letter in 16 bits, or a space."""
    table = np.full(0x110000, SPACE, np.uint64)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = ord(x.lower()[0])
            table[c] = low if low < 0xE000 else 0xE000 + low % 0x1900
    return table


def units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and spaces of all texts in a row, and how many each text has; runs of spaces are one."""
    flat = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t or "") for t in texts])
    letters = _letters()[flat]
    blank = letters == SPACE
    again = np.zeros(len(flat), bool)
    again[1:] = blank[1:] & blank[:-1] & (doc[1:] == doc[:-1])
    return letters[~again], np.bincount(doc[~again], minlength=len(texts))


def grams(letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each place, 16 bits a letter; before a text there are spaces."""
    at = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = letters.copy()
    for back in (1, 2, 3):
        before = np.full(len(letters), SPACE, np.uint64)
        before[back:] = np.where(at[back:] >= back, letters[:-back], SPACE)
        out |= before << np.uint64(16 * back)
    return out


class Sorted:
    """Values by hashed key in sorted arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys * MIX)
        self.hashes, self.values = (keys * MIX)[order], values[order].astype(np.float32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value (0 if not)."""
        if not len(self.hashes):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        h = keys * MIX
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        found = self.hashes[at] == h
        return found, np.where(found, self.values[at], 0.0)


class KneserNey:
    """Probabilities of the last letter of an n-gram given those before it."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, alphabet: int, order: int = 4):
        self.floor, self.levels = 1.0 / alphabet, []
        counts = counts.astype(float)
        for n in range(order, 0, -1):
            n1, n2 = (counts == 1).sum(), (counts == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 else 0.5
            context, which = np.unique(keys >> np.uint64(16), return_inverse=True)
            total, kinds = np.bincount(which, counts), np.bincount(which)
            seen = np.maximum(counts - discount, 0) / total[which]
            self.levels.append((n, Sorted(keys, seen), Sorted(context, discount * kinds / total)))
            # A lower order counts in how many contexts an n-gram is found, not how often.
            keys, counts = np.unique(keys & np.uint64((1 << 16 * (n - 1)) - 1), return_counts=True)
            counts = counts.astype(float)

    def probability(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), self.floor)
        for n, seen, left in reversed(self.levels):
            own = keys & np.uint64((1 << 16 * n) - 1) if n < 4 else keys
            known, rest = left.find(own >> np.uint64(16))
            # An unknown context says nothing: the order below stands.
            p = np.where(known, seen.find(own)[1] + rest * p, p)
        return p


@dataclass
class Model:
    langs: list[str]
    each: list[KneserNey]
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    long: np.ndarray = field(default_factory=lambda: np.zeros(0))
    short: np.ndarray = field(default_factory=lambda: np.zeros(0))
    sigmas: float = SIGMAS
    slack: float = SLACK

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy a letter by text and language, letters and spaces of each text, and whether it has a letter."""
        parts = [self._entropies(texts[p]) for p in pieces(texts)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        letters, sizes = units(texts)
        doc = np.repeat(np.arange(len(texts)), sizes)
        lettered = np.bincount(doc, letters != SPACE, minlength=len(texts)) > 0
        keys, at = np.unique(grams(letters, sizes), return_inverse=True)
        out = np.empty((len(texts), len(self.langs)))
        for k, model in enumerate(self.each):
            out[:, k] = -np.bincount(doc, np.log(model.probability(keys))[at], minlength=len(texts)) / np.maximum(sizes, 1)
        return out, sizes, lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is rejected."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        entropy, sizes, lettered = self.entropies(texts)
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(texts)), best]
        apart = np.minimum(np.maximum(sizes, 1), 50)[:, None] * (entropy - low[:, None])
        score = 1 / np.exp(-np.minimum(apart, 700)).sum(axis=1)
        spread = np.sqrt(self.long[best] + self.short[best] / np.maximum(sizes, 1))
        rejected = ~lettered | (low > self.mean[best] + self.sigmas * spread + self.slack)
        return [self.langs[b] if x else "und" for b, x in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0), rejected


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            found = [np.unique(grams(*units(own[p])), return_counts=True) for p in pieces(own)]
            keys, which = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            n = np.bincount(which, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def _modelled(alphabet: int):
    def run(rows: pa.Table) -> pa.Table:
        keys = rows.column("gram").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        made = KneserNey(keys[order], rows.column("n").to_numpy()[order], alphabet)
        return pa.table({"lang": rows.column("lang")[:1], "model": pa.array([pickle.dumps(made)], pa.binary())})

    return run


def lang_sample(known: DataFrame, sample: int, chars: int) -> DataFrame:
    """(lang, text): of each language about ``sample`` documents, or fewer if they have over ``chars`` characters;
    chosen by the hash of the id, one text an id."""
    n_ids, n_chars = F.greatest(F.approx_count_distinct("doc_id", 0.02), F.lit(1)), F.greatest(F.sum(F.length("text")), F.lit(1))
    rates = stored(known.groupBy("lang").agg(F.least(F.lit(1.0), sample / n_ids, chars / n_chars).alias("rate")), "rates")
    met = small_join(known, rates, ["lang"], F.col("doc_id")).where(spread_of(F.lit(4), "doc_id") < F.col("rate"))
    return one_text(met.select("doc_id", "lang", "text"), "doc_id", "lang")


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE, chars: int = CHARS) -> Model:
    """A model of ``docs`` (doc_id, text, lang) where ``learn`` holds; the driver gets the languages' models and
    the cross-entropies of the calibration texts."""
    with freed(docs.sparkSession):
        return _fit(docs.where(learn & F.col("lang").isNotNull()).select("doc_id", "lang", "text"), sample, chars)


def _fit(known: DataFrame, sample: int, chars: int) -> Model:
    chosen = lang_sample(known, sample, chars)
    texts = stored(chosen.select("lang", "text", (spread_of(F.lit(5), "doc_id") < CALIBRATION).alias("calibrate")), "lang_sample")
    counts = texts.where("NOT calibrate").select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    counts = stored(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    alphabet = counts.select(F.col("gram").bitwiseAND(F.lit(0xFFFF))).distinct().count() + 1
    made = counts.groupBy("lang").applyInArrow(_modelled(alphabet), "lang string, model binary").collect()
    model = Model([], [])
    for row in sorted(made, key=lambda r: r.lang):
        model.langs.append(row.lang)
        model.each.append(pickle.loads(bytes(row.model)))
    if not model.langs:
        return model

    held = known.sparkSession.sparkContext.broadcast(model)

    def own_entropy(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs = held.value.langs
        entropy, sizes, lettered = held.value.entropies(batch.column("text").to_pylist())
        k = np.array([langs.index(x) if x in langs else -1 for x in batch.column("lang").to_pylist()])
        keep = np.flatnonzero((k >= 0) & lettered)
        return pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(sizes[keep]), pa.array(entropy[keep, k[keep]])], ["k", "size", "h"])

    seen: pd.DataFrame = by_batch(texts.where("calibrate").select("lang", "text"), own_entropy, "k long, size long, h double").toPandas()
    model.mean, model.long, model.short = np.zeros((3, len(model.langs)))
    for k in range(len(model.langs)):
        own = seen[seen["k"] == k] if (seen["k"] == k).sum() >= 20 else seen
        if not len(own):
            model.mean[k], model.long[k], model.short[k] = np.inf, 0.0, 0.0
            continue
        model.mean[k] = own["h"].median()
        square = (own["h"] - model.mean[k]) ** 2
        model.long[k] = square.median() / 0.455  # the median of a squared standard normal variable
        model.short[k] = max((square * own["size"]).median() / 0.455, 1.0)
    return model


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred, score and rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages and their samples
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, rejected = held.value.predict(batch.column("__text").to_pylist())
        kept = [batch.column(i) for i in range(len(keep))]
        return pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*keep, "lang_pred", "score", "rejected"])

    return by_batch(docs.select(*keep, F.col("text").alias("__text")), of, f"{fields}, lang_pred string, score double, rejected boolean")


def held_out() -> Column:
    return remainder(F.col("doc_id"), 3) == 1


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, fit(docs, ~held_out()), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all its columns."""
    model = fit(docs, ~held_out())
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rejected = held.value.predict(batch.column(at).to_pylist())[2]
        return batch.filter(pa.array(~rejected))

    return by_batch(docs, of, docs.schema)
