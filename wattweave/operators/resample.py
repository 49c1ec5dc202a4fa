"""Resampling readings to hours and other bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import dedupe_timestamps, drop_sparse_columns, interpolate_to_grid, null_out_of_range


def _mean(c: str, skip_nulls: bool) -> Column:
    """Mean of a column; unless nulls are skipped, one null makes it null."""
    return F.avg(c) if skip_nulls else F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def to_hourly(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("uid",), ts: str = "ts", skip_nulls: bool = False) -> DataFrame:
    """Mean of every column per hour of the session's time zone."""
    return df.groupBy(*keys, F.date_trunc("hour", F.col(ts)).alias(ts)).agg(*[_mean(c, skip_nulls).alias(c) for c in cols])


def to_xmin(df: DataFrame, cols: Sequence[str], minutes: int = 15, keys: Sequence[str] = ("uid",), ts: str = "ts", skip_nulls: bool = False) -> DataFrame:
    """The same for bins of ``minutes`` that start on the hour's multiples."""
    size = 60 * minutes
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / size) * size)
    return df.groupBy(*keys, start.alias(ts)).agg(*[_mean(c, skip_nulls).alias(c) for c in cols])


def snap_nearest(df: DataFrame, minutes: int = 15, ts: str = "ts") -> DataFrame:
    """Whole minutes moved to the nearest mark; half way goes to the lower one."""
    size = minutes
    minute = F.floor(F.unix_timestamp(ts) / 60)
    return df.withColumn(ts, F.timestamp_seconds(F.ceil((minute - F.lit(size / 2.0)) / size) * size * 60))


def rollup_mean_of_means(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("uid",), ts: str = "ts") -> DataFrame:
    """Hourly mean of quarter-hourly means."""
    return to_hourly(to_xmin(df, cols, 15, keys, ts), cols, keys, ts)


def watts_to_kwh(df: DataFrame) -> DataFrame:
    """house, ch, hour, kwh: one-second watt readings added up."""
    return df.groupBy("house", "ch", F.date_trunc("hour", F.timestamp_seconds("utc")).alias("hour")).agg((F.sum("watt") / 3.6e6).alias("kwh"))


def align_devices(df: DataFrame, channels: Sequence[int]) -> DataFrame:
    """house, hour and a column ``ch_<n>`` per channel, for the hours that every device of a house has."""
    devices = df.groupBy("house").agg(F.countDistinct("ch").alias("_all"))
    wide = df.groupBy("house", "hour").agg(
        F.countDistinct("ch").alias("_n"), *[F.sum(F.when(F.col("ch") == c, F.col("kwh"))).alias(f"ch_{c}") for c in channels]
    )
    return wide.join(devices, "house").where("_n = _all").drop("_n", "_all")


def weather_hourly_pair(df: DataFrame, cols: Sequence[str] = ("temperature", "pressure"), ts: str = "ts") -> DataFrame:
    """Hourly means over the rows where every column is known."""
    return df.dropna(subset=list(cols)).groupBy(F.date_trunc("hour", F.col(ts)).alias(ts)).agg(*[F.avg(c).alias(c) for c in cols])


def weather_to_grids(feed: DataFrame, cols: Sequence[str], rules: dict, key: str = "station", order: str = "seq") -> DataFrame:
    """A feed cleaned, put on a minute grid and averaged to quarter-hours and hours: one table with a column ``grain``."""
    clean = dedupe_timestamps(null_out_of_range(feed, rules), [key, "ts"], order)
    kept = [c for c in cols if c in drop_sparse_columns(clean, 0.5, cols).columns]
    minute = interpolate_to_grid(clean, kept, 60, key)
    return (
        to_xmin(minute, kept, 15, [key]).withColumn("grain", F.lit("15min")).unionByName(to_hourly(minute, kept, [key]).withColumn("grain", F.lit("hour")))
    )
