"""Structured Streaming forms of two batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_buckets(sdf: DataFrame, time: str = "ts", mode: str = "mode", step: str = "10 seconds", watermark: str = "1 hour") -> DataFrame:
    """Trips per tumbling window and mode; rows later than the watermark are dropped."""
    counted = sdf.withWatermark(time, watermark).groupBy(F.window(time, step), mode).agg(F.count("*").alias("trips"))
    return counted.select(F.col("window.start").alias("start"), mode, "trips")


def stream_clusters(sdf: DataFrame, gap_s: int = 90, watermark: str = "1 hour") -> DataFrame:
    """Sessions of taps (route_name, o_key, ts) with gaps up to gap_s: start, end and count."""
    session = F.session_window("ts", f"{gap_s} seconds")
    counted = sdf.withWatermark("ts", watermark).groupBy(session, "route_name", "o_key").agg(F.count("*").alias("taps"), F.max("ts").alias("last"))
    return counted.select("route_name", "o_key", F.col("session_window.start").alias("first"), "last", "taps")


def run_available(result: DataFrame, path: str, checkpoint: str) -> None:
    """Processes all that is there, and writes closed windows as Parquet."""
    query = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
