"""Streams: files as they arrive, and windows over events. An extension; batch operators work on each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkbasin.operators.resume import changed


def ingest(spark: SparkSession, landing: str, schema, out: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None):
    """Read what has arrived in a folder since the last run, once, and append what process makes of it. A rerun adds nothing."""
    stream = spark.readStream.schema(schema).parquet(landing)
    if process:
        stream = process(stream)
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def fresh_files(batch: DataFrame, extracted: DataFrame) -> DataFrame:
    """Of a batch of files, one of each content that was never extracted."""
    return changed(batch, extracted).dropDuplicates(["source_hash"])


def event_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) by tumbling window; also for streams, where late events are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of events of a user without a longer gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", gap)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
