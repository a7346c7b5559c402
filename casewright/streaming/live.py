"""Detectors over streams (beyond what a finished case needs): watermarked windows and open sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bursts(stream: DataFrame, time: str, key: str, at_least: int, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Keys with at least so many events in a window: key, window_start, window_end, n_events, first_seen.

    Events later than ``late`` behind the newest are dropped by the watermark;
    state is one row per key and open window.
    """
    w = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n_events"), F.min(time).alias("first_seen"))
    return w.filter(F.col("n_events") >= at_least).select("value", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_events", "first_seen")


def failed_logons(stream: DataFrame, at_least: int = 5) -> DataFrame:
    """Addresses with many failed logons, from a stream of logon events."""
    bad = stream.filter("event_id = 4625 AND src_ip IS NOT NULL AND src_ip NOT IN ('', '-', '127.0.0.1')")
    return bursts(bad, "timestamp", "src_ip", at_least)


def open_sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream by Spark's session windows, closed when the watermark passes their end."""
    s = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), F.col(key).alias("entity")).agg(F.count(F.lit(1)).alias("n_events"), F.min(time).alias("start_ts"), F.max(time).alias("end_ts"))
    return s.select("entity", "start_ts", "end_ts", "n_events")
