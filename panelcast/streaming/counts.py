"""A streaming feed of the panel: events per key and hour, late ones up to a watermark, hours replaced idempotently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from panelcast.sources.sinks import replace_slice


def hourly_counts(stream: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """(key, hour_ts, y) of each hour; state is dropped once the watermark has passed an hour."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", "1 hour"), "key").agg(F.count("*").alias("y")).select("key", F.col("window.start").alias("hour_ts"), "y")


def feed(counts: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append closed hours to a table partitioned by hour; a batch that is replayed replaces its own hours."""

    def write(batch: DataFrame, _: int) -> None:
        replace_slice(batch, path, "hour_ts")

    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
