"""Streams: frames of a folder as they arrive, and windows over events. The batch operators run unchanged inside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch_bins(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, modificationTime, length, content) of new .bin files."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.bin").load(folder)


def each_frame(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Start a query that hands every micro-batch of frames to a batch pipeline."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(start, event_type, n, total): tumbling or sliding windows of events with a watermark; works on streams and tables."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", user: str = "user_id") -> DataFrame:
    """(user, start, end, n): runs of a user's events with gaps under `gap`."""
    s = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(s.alias("s"), user).agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
