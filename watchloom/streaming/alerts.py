"""Streams of articles or events against the static watch list. The transforms are the batch ones; state is bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_alerts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One alert for each user, type and hour: the state of an hour goes once the watermark has passed it."""
    e = events.withColumn("hour", F.window("ts", "1 hour").start)
    if events.isStreaming:
        return e.withWatermark("hour", late).dropDuplicates(["user_id", "event_type", "hour"]).select("user_id", "event_type", "hour")
    return e.select("user_id", "event_type", "hour").distinct()


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def match_stream(mentions: DataFrame, surfaces: DataFrame, sink, checkpoint: str):
    """Matches a stream of mentions with the static surfaces and hands each micro-batch to ``sink(df, batch_id)``."""
    found = mentions.join(surfaces, mentions.name == surfaces.surface)
    return found.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
