"""Sources that arrive as streams: exact repeats dropped, arrivals counted by window. An extension; batch is the measure of parity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_repeats(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose keys didn't arrive within the delay before; state is dropped behind the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def arrivals(stream: DataFrame, time: str, kind: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """(window_start, kind, n) by tumbling windows of event time."""
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, width), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "kind", "n")
