"""Errors of single rows: they are recorded by index, and the other rows go on."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR = "error"


def guarded(df: DataFrame, failed: Column, **values: Column) -> DataFrame:
    """``df`` with new columns, null where ``failed`` holds, and ``error``, true there. For expressions whose
    failures can be told beforehand, or that give null instead (``try_divide`` and the like)."""
    bad = F.coalesce(failed, F.lit(True))
    return df.withColumns({k: F.when(~bad, v) for k, v in values.items()}).withColumn(ERROR, bad)


def capture(df: DataFrame, function: Callable[[dict[str, Any]], dict[str, Any]], schema: str | T.StructType, idx: str = "idx") -> DataFrame:
    """``function`` of each row as a dict; (idx, result columns, error), where ``error`` is the message of what it threw."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = T.StructType([T.StructField(idx, df.schema[idx].dataType), *fields, T.StructField(ERROR, T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                try:
                    rows.append({idx: row[idx], ERROR: None} | function(row))
                except Exception as e:  # noqa: BLE001  what the row threw is its result
                    rows.append({idx: row[idx], ERROR: f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, out)


def errors(captured: DataFrame) -> DataFrame:
    return captured.where(F.col(ERROR).isNotNull() & (F.col(ERROR).cast("string") != "false"))


def results(captured: DataFrame) -> DataFrame:
    return captured.where(F.col(ERROR).isNull() | (F.col(ERROR).cast("string") == "false")).drop(ERROR)
