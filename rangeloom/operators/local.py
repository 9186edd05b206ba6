"""Objects that each task makes for itself, as each worker of an in-memory engine has its own."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame


def local_batches(df: DataFrame, function: Callable, schema: str, make: Callable[[], Any] | None = None) -> DataFrame:
    """``function`` over iterators of Arrow batches; with ``make``, over (own object, batch) one at a time."""
    if make is None:
        return df.mapInArrow(function, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for batch in batches:
            yield function(own, batch)

    return df.mapInArrow(run, schema)
