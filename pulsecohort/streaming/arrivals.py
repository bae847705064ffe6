"""Waveform files as they arrive: bounded micro-batches, metrics appended once each.

An extension: the batch operators are run unchanged on each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pulsecohort.sources.views import WAVEFORM


def arriving(spark: SparkSession, folder: str, files: int = 16) -> DataFrame:
    """Waveform rows of a folder of Parquet files, at most ``files`` a micro-batch."""
    return spark.readStream.schema(WAVEFORM).option("maxFilesPerTrigger", files).parquet(folder)


def process(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply an operator to each micro-batch and write it to a folder of its own, so that a batch that is repeated replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
