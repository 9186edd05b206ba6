"""Chooses the settings of toxicity (2), language ID (4) and quality (5): ``python -m rangeloom.llm.choose [sf_dir]``.

Each query holds out rows by the crc32 of their id. This script never reads the label or language of a row
that is held out: it cuts a validation fold out of the other rows (``FOLDS``), fits each setting of a grid on
what is left, and prints the settings by what the validation fold says. The constants in the modules are what
came out; nothing was tried on held-out rows after that.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.llm import factorisation, language, toxicity
from rangeloom.llm.common import marked, one_text, remainder

#: By query: the modulus and remainder that it holds out, and the modulus and remainders of the validation fold.
FOLDS = {"op2": (5, 0, 5, (1,)), "op4": (3, 1, 12, (0, 2)), "op5": (4, 2, 8, (1, 5))}


def folds(name: str) -> tuple[Column, Column]:
    """Whether a row is held out, and whether it is in the validation fold (never both)."""
    n, held, m, own = FOLDS[name]
    out = remainder(F.col("doc_id"), n) == held
    return out, ~out & remainder(F.col("doc_id"), m).isin(*own)


def loss(y: np.ndarray, p: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def shown(name: str, results: list[tuple]) -> None:
    for r in sorted(results, key=lambda r: r[0]):
        print(name, " ".join(f"{k}={v}" for k, v in r[1].items()), f"loss={r[0]:.4f}", *(f"{k}={v:.4f}" for k, v in r[2].items()))


def validation(docs: DataFrame, labels: DataFrame, column: str, own: Column) -> list:
    known = marked(labels, column, ~own)
    return one_text(docs.join(F.broadcast(known), "doc_id"), "doc_id", "y").orderBy("doc_id").collect()


def toxic(docs: DataFrame, labels: DataFrame) -> None:
    held, own = folds("op2")
    rows = validation(docs.select("doc_id", "text"), labels, "toxic", own)
    y, results = np.array([r.y for r in rows]), []
    for starts, scale, most in itertools.product((True, False), (None, 500), (500, 1500, 4000)):
        if not starts and scale:
            continue  # only beginnings are scaled
        p = toxicity.fit(docs, labels, held | own, most=most, scale=scale, starts=starts).score([r.text for r in rows])
        results.append((loss(y, p), {"starts": starts, "scale": scale, "features": most}, {"accuracy": ((p >= 0.5) == y).mean()}))
    shown("op2", results)


def quality(docs: DataFrame, labels: DataFrame) -> None:
    held, own = folds("op5")
    rows = validation(docs.select("doc_id", "text", "n_chars"), labels, "quality", own)
    y, results = np.array([r.y for r in rows]), []
    out = held | own
    got = factorisation.inputs_of(docs.where(~out).select("doc_id", "text", "n_chars"), marked(labels, "quality", out))
    for epochs, steps, rate in itertools.product((3, 6, 12), (200, 400, 800), (0.04, 0.08, 0.16)):
        p = factorisation.learnt(got, epochs=epochs, steps=steps, rate=rate).score([r.text for r in rows], [r.n_chars for r in rows])
        results.append((loss(y, p), {"epochs": epochs, "steps": steps, "rate": rate}, {"accuracy": ((p >= 0.7) == y).mean()}))
    shown("op5", results)


def turned(text: str) -> str:
    """A text in no language: its letters moved along the alphabet."""
    return "".join(chr((ord(c) - 97 + 7) % 26 + 97) if "a" <= c <= "z" else c for c in text.lower())


def rejection(docs: DataFrame) -> None:
    """Kept are texts in a language, rejected the same texts with their letters exchanged."""
    held, own = folds("op4")
    model = language.fit(docs, ~(held | own))
    texts = [r.text for r in docs.where(own & F.col("lang").isNotNull()).select("doc_id", "text").orderBy("doc_id").collect()]
    results = []
    for sigmas, slack in itertools.product((2.0, 4.0, 6.0, 8.0), (0.0, 0.1, 0.3, 0.5, 1.0)):
        model.sigmas, model.slack = sigmas, slack
        lost, alien = model.predict(texts)[2].mean(), model.predict([turned(t or "") for t in texts])[2].mean()
        results.append((lost + 1 - alien, {"sigmas": sigmas, "slack": slack}, {"lost": lost, "caught": alien}))
    shown("op4", results)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rejection(docs)
    quality(docs, labels)
    toxic(docs, labels)


if __name__ == "__main__":
    main()
