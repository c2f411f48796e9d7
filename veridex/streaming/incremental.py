"""Structured Streaming extension: incremental forms of event summaries. The batch pipelines have no streams of their own.

Each function takes a batch or a streaming DataFrame and gives the same plan; tests compare both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _marked(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark; event time without a zone is read in the session's zone, as watermarks need one."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums per window and type; rows later than the watermark are dropped by the stream, not by a batch."""
    marked = _marked(events, late)
    return marked.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    marked = _marked(events, late)
    return marked.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """Sessions of a user: activity without a gap of ``gap`` or more."""
    marked = _marked(events, late)
    return marked.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n", "total")


def append(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Run what has arrived and stop: exactly-once files through the checkpoint."""
    return stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
