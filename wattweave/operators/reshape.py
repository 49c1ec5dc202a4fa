"""Between wide and long forms, categories and day vectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("C", "H", "user", "lights", "always_on", "scheduled")


def wide_day_to_long(df: DataFrame, prefix: str = "hkw", hours: int = 24, day: str = "day") -> DataFrame:
    """One row for each hour column ``<prefix>1..`` of a day; repeated rows are dropped."""
    ids = [c for c in df.columns if not (c.startswith(prefix) and c[len(prefix) :].isdigit()) and c != day]
    vector = F.array(*[F.col(f"{prefix}{h}").cast("double") for h in range(1, hours + 1)])
    long = df.select(*ids, day, F.posexplode(vector).alias("_h", "value"))
    at = F.timestamp_seconds(F.unix_timestamp(F.col(day).cast("timestamp")) + F.col("_h") * 3600)
    return long.select(*ids, at.alias("ts"), "value").distinct()


def long_to_day_profile(df: DataFrame, value: str, key: str = "uid", ts: str = "ts") -> DataFrame:
    """uid, day, v: the 24 values of each day that has all its hours."""
    cell = F.struct(F.hour(ts).alias("h"), F.col(value).cast("double").alias("v"))
    days = df.groupBy(key, F.to_date(ts).alias("day")).agg(F.array_sort(F.collect_list(cell)).alias("_v"))  # 24 cells at most
    return days.where(F.size("_v") == 24).select(key, "day", F.transform("_v", lambda x: x["v"]).alias("v"))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None) -> DataFrame:
    values = values or [c for c in df.columns if c not in ids]
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(list(ids), list(values), "variable", "value")


def cast(df: DataFrame, rows: Sequence[str], col: str, value: str, levels: Sequence) -> DataFrame:
    """Long to wide over stated levels: the sum of the values of each, null where there is none."""
    return df.groupBy(*rows).pivot(col, list(levels)).agg(F.sum(value))


def sum_columns(df: DataFrame, names: Sequence[str]) -> Column:
    """Row sum over those of the names that are columns; nulls, and having none, count 0."""
    return reduce(lambda a, c: a + F.coalesce(F.col(c), F.lit(0.0)), [c for c in names if c in df.columns], F.lit(0.0))


def to_categories(
    readings: DataFrame, mapping: DataFrame, residual: str | None = "nonHVAC", categories: Sequence[str] = CATEGORIES, cap: float | None = None,
    keys: Sequence[str] = ("uid", "ts"),
) -> DataFrame:
    """total and the sum of each end-use category of each time.

    ``mapping(circuit, category)`` may name several categories for a circuit.
    ``residual="nonHVAC"`` adds total - C - H, ``"user"`` puts into user the
    total less all other categories. Values over ``cap`` become null first.
    """
    kw = F.col("kw") if cap is None else F.when(F.col("kw") <= cap, F.col("kw"))
    rows = readings.withColumn("kw", kw)
    total = rows.groupBy(*keys).agg(F.sum("kw").alias("total"))
    parts = rows.join(mapping, "circuit").groupBy(*keys).agg(*[F.sum(F.when(F.col("category") == c, F.col("kw"))).alias(c) for c in categories])
    out = total.join(parts, list(keys), "left")
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    if residual == "nonHVAC":
        return out.withColumn("nonHVAC", F.col("total") - known("C") - known("H"))
    if residual == "user":
        return out.withColumn("user", F.col("total") - reduce(lambda a, c: a + known(c), [c for c in categories if c != "user"], F.lit(0.0)))
    return out


def concat_align_schema(dfs: Sequence[DataFrame]) -> DataFrame:
    """All rows; columns that a table lacks are null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def pairwise_columns(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """xvar, yvar, x, y of every ordered pair of columns of a row, a column with itself too."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])
    x = df.select(*ids, cells.alias("_c")).select(*ids, "_c", F.explode("_c").alias("_x"))
    return x.select(*ids, "_x", F.explode("_c").alias("_y")).select(
        *ids, F.col("_x.name").alias("xvar"), F.col("_y.name").alias("yvar"), F.col("_x.v").alias("x"), F.col("_y.v").alias("y")
    )
