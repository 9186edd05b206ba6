"""Statistics of whole texts, for the quality operators; all exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?'\"()-")] = True
_FIRST = np.ones(256, bool)
_FIRST[0x80:0xC0] = False  # bytes that go on with a character

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_punct", "n_distinct", "longest_word", "n_bangs")
AT = {n: i for i, n in enumerate(NAMES)}


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in a window of ``window`` words that occurs twice or more in the text.

    Windows get equal numbers exactly if they are equal: numbers of pairs, of pairs of pairs, and so on.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words))
    if len(first) > len(words) - window:  # too few repeats for a second window
        return 0
    span = 1
    while span < window:
        ids = np.unique(ids[:-span] * (ids.max() + 1) + ids[span:], return_inverse=True)[1]
        span *= 2
    again = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += again
    edge[window : window + n] -= again
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> list[int]:
    """The numbers named in ``NAMES``; all 0 for null."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0] * len(NAMES)
    words = raw.split()
    b = np.frombuffer(raw, np.uint8)
    n = np.bincount(b, minlength=256)
    chars = int(n[_FIRST].sum())
    lines = raw.split(b"\n")
    full = [x for x in lines if x.strip()] if b"\n" in raw else [x for x in lines if words]
    return [
        len(words), chars - int(n[_BLANK].sum()), int(n[_SYMBOL].sum()), len(full) - len(set(full)), repeated_words(words), chars,
        len(lines), int(n[_UPPER].sum()), int(n[_DIGIT].sum()), int(n[_PUNCT].sum()), len(set(words)), max(map(len, words), default=0), int(n[33]),
    ]


def table(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], np.int64).reshape(len(texts), len(NAMES))


#: Features for the models, from the numbers above.
FEATURES = (
    "log_words", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share",
    "distinct_share", "mean_word", "longest_word", "words_a_line", "bang_share",
)


def features(t: np.ndarray) -> np.ndarray:
    """Rows of ``FEATURES`` from rows of ``NAMES``."""
    x = {name: t[:, i].astype(float) for name, i in AT.items()}
    words, chars, lines = (np.maximum(x[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.stack(
        [
            np.log1p(x["n_words"]), x["n_symbols"] / chars, x["n_dup_lines"] / lines, x["n_repeat_words"] / words, x["n_upper"] / chars, x["n_digits"] / chars,
            x["n_punct"] / chars, x["n_distinct"] / words, x["word_chars"] / words, np.log1p(x["longest_word"]), np.log1p(words / lines), x["n_bangs"] / words,
        ],
        axis=1,
    )


def as_batch(ids: pa.Array, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *(pa.array(v) for v in columns.values())], ["doc_id", *columns])
