"""Receivers: a bag that a stream's batches are appended to, as parallel producers append to a shared one."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rangeloom.operators.bag import BagFrame


class StreamReceiver:
    """Appends each micro-batch under ``path``; a batch that is run again replaces its own files, so rows arrive once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def accept(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, **options: Any) -> StreamingQuery:
        writer = transform(stream).writeStream.foreachBatch(self.accept).option("checkpointLocation", checkpoint)
        return writer.trigger(**(options or {"availableNow": True})).start()

    def bag(self) -> BagFrame:
        return BagFrame(self.spark.read.parquet(self.path).drop("batch"))
