"""Hourly roll-up of a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_stream(readings: DataFrame, key: str = "uid", ts: str = "ts", value: str = "kw", late: str = "2 hours") -> DataFrame:
    """uid, ts, obs, n of each hour of a streaming DataFrame; readings later than ``late`` are left out.

    An hour is emitted, in append mode, once the watermark has passed it.
    """
    window = F.window(F.col(ts), "1 hour")
    sums = readings.withWatermark(ts, late).groupBy(window.alias("w"), key).agg(F.sum(value).alias("obs"), F.count(F.lit(1)).alias("n"))
    return sums.select(key, F.col("w.start").alias(ts), "obs", "n")
