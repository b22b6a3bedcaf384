"""Streaming forms of session activity: gap-based windows and sliding expiry over a stream of touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity_windows(touches: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Touches (user_id, ts, value) summed per session: a session ends when a user pauses for ``gap``; later rows than ``lateness`` are void."""
    at = F.col("ts").cast("timestamp")
    return (touches.withColumn("at", at).withWatermark("at", lateness).groupBy("user_id", F.session_window("at", gap).alias("w"))
            .agg(F.count("*").alias("touches"), F.sum("value").alias("value")).select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("expires_at"), "touches", "value"))


def drain(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Runs a bounded stream to its end into an in-memory table; for tests and small refreshes."""
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
