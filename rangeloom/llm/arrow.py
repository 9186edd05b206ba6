"""Batches of texts for the operators that score them with numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows and bytes of text that a function gets at once (one longer text by itself). Spark bounds the bytes
#: of what arrives; these bound what a worker makes of it.
BATCH_ROWS, BATCH_BYTES = 500, 4_000_000
#: Characters that numpy code takes at once, for batches of very long texts.
PIECE_CHARS = 250_000


def pieces(texts: list[str | None], most: int = PIECE_CHARS) -> Iterator[slice]:
    """Stretches of a batch of about ``most`` characters at most, or of one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if texts:
        yield slice(start, len(texts))


def slices(batches: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in stretches of at most ``rows`` rows and ``most`` bytes of strings (or of one row). A batch is let go
    before the next is read, if callers let go of its stretches."""
    for batch in batches:
        ends, start = np.cumsum(_bytes(batch)), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + most, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop
        del batch


def _bytes(batch: pa.RecordBatch) -> np.ndarray:
    """Bytes of strings by row."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    return sizes


def by_batch(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``function`` over small stretches of ``df``'s Arrow batches; the session's settings stay as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = function(batch)
            del batch
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)
