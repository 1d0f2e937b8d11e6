"""Windowed counts of events, the same for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """event_type, hour, n. On a stream, rows later than ``late`` are left out."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("hour"), "n")


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def run_to_memory(df: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a streaming frame over what is there, into a table in memory (for tests)."""
    q = df.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
