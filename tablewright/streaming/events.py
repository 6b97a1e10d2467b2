"""An addition beside the dialect: event-time aggregates as structured streams over files, with bounded state.

The same function serves a batch and a stream, so a stream's result can be held against the batch's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums of ``value`` per window and ``by``; rows later than ``late`` behind the newest are dropped by a stream."""
    at = events.withColumn("at", F.col("ts").cast("timestamp"))
    at = at.withWatermark("at", late) if events.isStreaming else at
    grouped = at.groupBy(F.window("at", every).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), by, "n", "total")


def follow(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, **options: str) -> StreamingQuery:
    """A stream over the Parquet files of ``folder`` that writes finished windows below ``out`` and ends when all files are read."""
    source = spark.readStream.schema(schema).parquet(folder)
    return windowed(source, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
