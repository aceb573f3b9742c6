"""Running image sums over a stream of pixels, with a watermark that bounds the state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_mean(pixels: DataFrame, time: str, length: str, late: str) -> DataFrame:
    """Mean power and count of pixels (i, j, p) by tumbling window; rows later than ``late`` are dropped by the watermark."""
    return pixels.withWatermark(time, late).groupBy(F.window(time, length), "i", "j").agg(F.avg("p").alias("p"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "i", "j", "p", "n")


def running_sum(contributions: DataFrame) -> DataFrame:
    """Complex sums (i, j, re, im) so far, for output mode ``complete`` or ``update``: backprojection of pulses as they arrive."""
    return contributions.groupBy("i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
