"""Structured Streaming: windowed counts, sessions and ingest of new corpus files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarks a stream; its event time has to be a timestamp with a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed(events: DataFrame, late: str = "1 hour", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by event time; rows later than ``late`` are left out when streaming."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = _timed(events, late)
    return out.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): runs of events of a user without a gap."""
    out = _timed(events, late)
    return out.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def new_files(spark: SparkSession, folder: str, schema, files: int = 8) -> DataFrame:
    """Parquet files of a folder as they come, so many at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def run_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now to Parquet, exactly once, and stops."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
