"""Joins of usage, weather, places and grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clean import dedupe_timestamps


def join_weather(df: DataFrame, weather: DataFrame, on: Sequence[str] = ("ts",)) -> DataFrame:
    """Usage with the weather of its time. Spark broadcasts the weather where its size allows."""
    return df.join(weather, list(on))


def align_covariates(obs: DataFrame, covars: DataFrame, order: str, keys: Sequence[str] = ("uid", "ts")) -> DataFrame:
    """Observations and covariates of the keys that both have, after de-duplication and without rows that hold a null."""
    left = dedupe_timestamps(obs, keys, order).drop(order).dropna()
    on = [k for k in keys if k in covars.columns]
    return left.join(dedupe_timestamps(covars, on, order).drop(order).dropna() if order in covars.columns else covars.dropna().dropDuplicates(on), on)


def band_join(df: DataFrame, value: str, low: int, high: int, width: int = 1) -> DataFrame:
    """Every row with each integer ``grid`` in [low, high] that is within ``width`` of its value.

    A band join as an expansion: the integers near a value are listed, so
    nothing has to be compared with the whole grid.
    """
    first = F.greatest(F.ceil(F.col(value) - width).cast("int"), F.lit(low))
    last = F.least(F.floor(F.col(value) + width).cast("int"), F.lit(high))
    return df.where(F.col(value).isNotNull()).where(first <= last).withColumn("grid", F.explode(F.sequence(first, last)))


def lookup_zip_weather(df: DataFrame, zips: DataFrame, weather: DataFrame) -> DataFrame:
    """uid -> zip -> the zip's weather at the time."""
    return df.join(zips, "uid").join(weather, ["zip", "ts"])


def with_suffix(df: DataFrame, suffix: str, keys: Sequence[str]) -> DataFrame:
    """Columns other than the keys get a suffix, for joins of tables with the same columns."""
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns if c not in keys})


def join_on_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Inner join on several keys; columns that both have get suffixes."""
    both = [c for c in a.columns if c in b.columns and c not in keys]
    return a.withColumnsRenamed({c: c + suffixes[0] for c in both}).join(b.withColumnsRenamed({c: c + suffixes[1] for c in both}), list(keys))


def regions_with_values(regions: DataFrame, values: DataFrame, key: str, order: str) -> DataFrame:
    """Every row of a region (the points of its outline, say) with its values, by id and then ``order``, with its ``place`` in that order."""
    from wattweave.spread import ordered_rank

    return ordered_rank(regions.join(values, key), [F.col(key), F.col(order)], "place").orderBy("place")
