"""Ordered operators: splits, ranks, running sums, differences, autocorrelation."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattweave.functions.vectors import square_distance
from wattweave.spread import ordered_rank, running_sum


def train_test_split_by_time(df: DataFrame, frac: float, key: str = "uid", ts: str = "ts") -> DataFrame:
    """Adds ``is_train``: the first floor(n * frac) rows of each key, ``frac`` as it is written: 0.7 of 90 is 63."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    i = F.row_number().over(Window.partitionBy(key).orderBy(ts))
    return df.withColumn("is_train", i <= F.floor(n * F.lit(Decimal(repr(frac)))))


def odd_even_split(df: DataFrame, key: str = "uid", ts: str = "ts") -> DataFrame:
    """Adds ``fold``: 1 for the first, third, ... row of a key, else 0."""
    return df.withColumn("fold", F.row_number().over(Window.partitionBy(key).orderBy(ts)) % 2)


def expanding_horizon_metrics(df: DataFrame, periods: int, obs: str = "obs", fit: str = "fit", key: str = "uid", ts: str = "ts") -> DataFrame:
    """uid, period, mape, r2 over periods 1..p of a key's rows, cut into equal periods.

    MAPE divides by the fit; R2 is 1 - SSE / SST about the running mean.
    """
    w = Window.partitionBy(key)
    i, n = F.row_number().over(w.orderBy(ts)), F.count(F.lit(1)).over(w)
    rows = df.withColumn("period", (F.floor((i - 1) * periods / n) + 1).cast("int"))
    err = F.col(obs) - F.col(fit)
    sums = rows.groupBy(key, "period").agg(
        F.sum(F.when(F.col(fit) != 0, F.abs(err / F.col(fit)))).alias("a"), F.count(F.when(F.col(fit) != 0, 1)).alias("na"),
        F.sum(err * err).alias("sse"), F.sum(obs).alias("s"), F.sum(F.col(obs) * F.col(obs)).alias("ss"), F.count(obs).alias("n"),
    )
    run = w.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    c = {x: F.sum(x).over(run) for x in ("a", "na", "sse", "s", "ss", "n")}
    sst = c["ss"] - c["s"] * c["s"] / c["n"]
    return sums.select(key, "period", (c["a"] / c["na"]).alias("mape"), F.when(sst > 0, 1 - c["sse"] / sst).alias("r2"))


def top_k(df: DataFrame, by: str, k: int, tie: str = "uid", partition: Sequence[str] = ()) -> DataFrame:
    """The k rows with the largest absolute value (per partition), with ``rank``; ties by ``tie``."""
    order = [F.abs(F.col(by)).desc(), F.col(tie)]
    if not partition:  # a top-k takes k rows of each task; no full sort
        df = df.orderBy(*order).limit(k)
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).where(F.col("rank") <= k)


def cumulative_contribution(df: DataFrame, model: str, truth: str, by: Sequence[str] = (), tie: str = "uid") -> DataFrame:
    """by, n, cum_model, cum_truth, rel_err: absolute true response of the first n under the model's order and under its own.

    Rows are numbered by ranges of the order and summed in blocks, so a group, or the
    table as a whole, may be of any size. Rows whose ``by`` is null are left out.
    """
    rows = df.where(F.lit(True) if not by else reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by]))

    def run(order: str, name: str) -> DataFrame:
        told = rows.select(*by, F.abs(F.col(order)).alias("_order"), F.col(tie).alias("_tie"), F.abs(F.col(truth)).cast("double").alias("_truth"))
        placed = ordered_rank(told, [F.col("_order").desc(), F.col("_tie")], "n", by)
        return running_sum(placed, "n", F.col("_truth"), name, by).select(*by, "n", name)

    both = run(model, "cum_model").join(run(truth, "cum_truth"), [*by, "n"])
    gap = F.col("cum_truth") - F.col("cum_model")
    return both.withColumn("rel_err", F.when(F.col("cum_truth") > 0, gap / F.col("cum_truth")))


def temperature_gradient(df: DataFrame, value: str, grid: str = "grid", key: str = "uid") -> DataFrame:
    """Adds ``slope``: the difference to the previous grid point; nulls take the last known, then the next."""
    w = Window.partitionBy(key).orderBy(grid)
    diff = df.withColumn("_d", F.col(value) - F.lag(value).over(w))
    back = F.last("_d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.last("_d", ignorenulls=True).over(Window.partitionBy(key).orderBy(F.col(grid).desc()).rowsBetween(Window.unboundedPreceding, 0))
    return diff.withColumn("slope", F.coalesce(back, ahead)).drop("_d")


def similar_days(profiles: DataFrame, forecast: Column, d: int, key: str = "uid", day: str = "day", vector: str = "v") -> DataFrame:
    """uid, day, distance, rank of the d days of each key that are nearest to the forecast (an array column)."""
    near = profiles.select(key, day, F.sqrt(square_distance(F.col(vector), forecast)).alias("distance"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("distance", day))).where(F.col("rank") <= d)


def _lagged_sums(df: DataFrame, values: Sequence[str], max_lag: int, key: str, ts: str) -> DataFrame:
    """key, and of the i-th value n{i}, square{i} and lags{i}: its count and sums of products about its mean, all from one order of a key's rows.

    A value's rows are those where it isn't null, and a lag counts these alone. Means come from the
    whole frame of the same order, so that a task sorts once and holds the rows of one sort.
    """
    names = [f"v{i}" for i in range(len(values))]
    whole = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    any_ = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values])
    rows = df.where(any_).select(F.col(key).alias("k"), F.col(ts).alias("t"), *[F.col(v).alias(n) for n, v in zip(names, values, strict=True)])
    centred = rows.select("k", "t", *[(F.col(n) - F.avg(n).over(whole)).alias(n) for n in names])
    ignore = "IGNORE NULLS" if len(names) > 1 else ""  # of a single value none is null here
    at = {(n, lag): f"{n}_{lag}" for n in names for lag in range(1, max_lag + 1)}
    lagged = centred.select("k", *names, *[F.expr(f"lag({n}, {lag}) {ignore} OVER (PARTITION BY k ORDER BY t)").alias(a) for (n, lag), a in at.items()])
    sums = [
        s
        for i, n in enumerate(names)
        for s in (F.sum(F.col(n) * F.col(n)).alias(f"square{i}"), F.count(n).alias(f"n{i}"), F.array(*[F.sum(F.col(n) * F.col(at[n, lag])) for lag in range(1, max_lag + 1)]).alias(f"lags{i}"))
    ]
    return lagged.groupBy("k").agg(*sums).withColumnRenamed("k", key)


def acf(df: DataFrame, value: str, max_lag: int, z: float = 1.96, key: str = "uid", ts: str = "ts") -> DataFrame:
    """uid, lag, acf (denominator n), significant (|acf| > z / sqrt n). All lags come from one ordered window and one aggregation."""
    sums = _lagged_sums(df, [value], max_lag, key, ts)
    told = sums.select(key, "square0", "n0", F.posexplode("lags0").alias("lag", "s")).where("s IS NOT NULL")
    r = F.when(F.col("square0") > 0, F.col("s") / F.col("square0"))
    return told.select(key, (F.col("lag") + 1).alias("lag"), r.alias("acf"), (F.abs(r) > z / F.sqrt("n0")).alias("significant"))


def acf_against_model(df: DataFrame, value: str, model: str, max_lag: int, key: str = "uid", ts: str = "ts", z: float = 1.96) -> DataFrame:
    """uid, lag, acf of the value and acf_model of the model's fit, and whether the first is significant: lags that both have, from one pass."""
    sums = _lagged_sums(df.where(F.col(key).isNotNull()), [value, model], max_lag, key, ts)
    both = F.posexplode(F.arrays_zip(F.col("lags0").alias("s"), F.col("lags1").alias("m"))).alias("lag", "both")
    told = sums.select(key, "square0", "square1", "n0", both).where("both.s IS NOT NULL AND both.m IS NOT NULL")
    r = F.when(F.col("square0") > 0, F.col("both.s") / F.col("square0"))
    own = F.when(F.col("square1") > 0, F.col("both.m") / F.col("square1"))
    return told.select(key, (F.col("lag") + 1).alias("lag"), r.alias("acf"), (F.abs(r) > z / F.sqrt("n0")).alias("significant"), own.alias("acf_model"))


def pacf(acf_table: DataFrame, key: str = "uid") -> DataFrame:
    """uid, lag, pacf from an acf table, by the Durbin-Levinson recursion over each key's array of correlations."""
    series = acf_table.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda s: s["acf"]).alias("r")  # max_lag values
    )
    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("phi"), empty.alias("out"))

    def step(acc: Column, k: Column) -> Column:
        phi = acc["phi"]
        r = lambda i: F.element_at(F.col("r"), i)
        back = F.reverse(phi)
        dot = lambda v, w: F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        upto = F.slice(F.col("r"), F.lit(1), k - 1)
        num, den = r(k) - dot(phi, F.reverse(upto)), F.lit(1.0) - dot(phi, upto)
        new = F.when(den != 0, num / den)
        moved = F.zip_with(phi, back, lambda a, b: a - new * b)
        return F.struct(F.concat(moved, F.array(new)).alias("phi"), F.concat(acc["out"], F.array(new)).alias("out"))

    done = series.select(key, F.aggregate(F.sequence(F.lit(1), F.size("r")), start, step, lambda acc: acc["out"]).alias("p"))
    return done.select(key, F.posexplode("p").alias("lag", "pacf")).select(key, (F.col("lag") + 1).alias("lag"), "pacf")


def sort_rows(df: DataFrame, *keys: str) -> DataFrame:
    """All rows in the order of the keys, with their ``place`` in it from 1."""
    return ordered_rank(df, [F.col(k) for k in keys], "place").orderBy("place")


def first_last_observation(df: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    return df.groupBy(key).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def interval_slice(df: DataFrame, start: str, stop: str, ts: str = "ts") -> DataFrame:
    """Rows from ``start`` to ``stop``, both included; the filter reaches the scan."""
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(stop).cast("timestamp")))
