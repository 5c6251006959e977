"""Resumable processing of a landing folder, as a file stream: an optional extra beside the batch anti-join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def process_new(spark: SparkSession, landing: str, schema: StructType | str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Applies step to each batch of new parquet files in landing and writes to out/batch=N; a batch that is run again overwrites itself.

    The stream ends when all present files are done; calling again takes up only files that have come since.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, size: str, late: str) -> DataFrame:
    """Events by kind and tumbling window; on a stream, rows later than `late` are dropped by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
