"""Responses scored as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def response_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """New parquet files under ``path`` (a glob) as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_deliveries(stream: DataFrame, row_id: str, time: str, delay: str) -> DataFrame:
    """The first delivery of each row; its id is kept for ``delay`` after it, so that state doesn't grow without end."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([row_id])


def per_period(stream: DataFrame, time: str, period: str) -> DataFrame:
    """period_start, n_rows, total_weight of each period of event time; late rows count in their own period."""
    grouped = stream.groupBy(F.window(time, period).alias("w"))
    return grouped.agg(F.count("*").alias("n_rows"), F.sum("weight").alias("total_weight")).select(F.col("w.start").alias("period_start"), "n_rows", "total_weight")


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True):
    """Scores each batch and writes it to its own folder under ``out``; a batch that is repeated overwrites that folder."""

    def save(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def complete_table(stream: DataFrame, out: str, checkpoint: str):
    """Writes the whole result table anew after each batch (small results)."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return stream.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
