"""Batch operators over files as they arrive, and windows over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, path: str, schema: str, build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, format: str = "parquet") -> StreamingQuery:
    """Run ``build`` on each batch of new files and write its result under the batch's number, so a repeated batch replaces itself."""

    def batch(df: DataFrame, number: int) -> None:
        build(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).format(format).load(path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type, with a watermark; the same on a static table."""
    windowed = events.withWatermark("ts", late) if events.isStreaming else events
    return windowed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
