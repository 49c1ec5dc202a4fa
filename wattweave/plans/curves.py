"""Response curves against temperature: local regression and two-segment fits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattweave.spread import ordered_rank, running_sum
from wattweave.storage import cut_lineage


def truth_response_curve(df: DataFrame, value: str, t: str, low: int, high: int, width: float = 10.0, key: str = "uid") -> DataFrame:
    """uid, grid, fit, slope: tricube-weighted regression of the value on temperature around each grid degree.

    Every row is listed at the degrees within ``width`` of it, so that one
    aggregation of weighted sums serves all degrees. One pass, without
    robustness rounds; null where fewer than two temperatures are near.
    """
    from wattweave.operators.joins import band_join

    near = band_join(df.where(F.col(value).isNotNull()), t, low, high, int(width))
    u = F.abs(F.col(t) - F.col("grid")) / width
    w = F.when(u < 1, F.pow(1 - F.pow(u, 3), 3)).otherwise(0.0)
    x = F.col(t) - F.col("grid")
    s = near.select(key, "grid", w.alias("w"), x.alias("x"), F.col(value).alias("y")).groupBy(key, "grid").agg(
        F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("x")).alias("s1"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("s2"),
        F.sum(F.col("w") * F.col("y")).alias("t0"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("t1"),
    )
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    return s.select(
        key, "grid", F.when(det > 1e-9, (F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / det).alias("fit"),
        F.when(det > 1e-9, (F.col("s0") * F.col("t1") - F.col("s1") * F.col("t0")) / det).alias("slope"),
    )


def _local_lines(x: np.ndarray, n: np.ndarray, w: np.ndarray, wy: np.ndarray, k: int, block: int = 256) -> np.ndarray:
    """The tricube-weighted line around each of a user's points, at the point; its level alone where the points hardly spread; NaN without weight.

    A neighbourhood reaches as far as ``k`` rows lie. ``block`` points meet all others at a time.
    """
    least, told = 0.001 * (x[-1] - x[0]), np.empty(len(x))
    for at in range(0, len(x), block):
        z = x[None, :] - x[at : at + block, None]
        d = np.abs(z)
        order = np.argsort(d, axis=1, kind="stable")
        last = np.minimum((np.cumsum(n[order], axis=1) < k).sum(axis=1), len(x) - 1)
        h = np.take_along_axis(d, np.take_along_axis(order, last[:, None], axis=1), axis=1)
        u = np.divide(d, h, out=np.zeros_like(d), where=h > 0)
        kernel = np.where(d <= 0.001 * h, 1.0, np.where(d <= 0.999 * h, (1 - u**3) ** 3, 0.0))
        kw, kwy = kernel * w, kernel * wy
        s0 = kw.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            mean, y = (kw * z).sum(axis=1) / s0, kwy.sum(axis=1) / s0
            spread = (kw * z * z).sum(axis=1) / s0 - mean * mean
            tilted = y - mean / spread * ((kwy * z).sum(axis=1) / s0 - mean * y)
            told[at : at + block] = np.where(s0 > 0, np.where(np.sqrt(np.maximum(spread, 0.0)) > least, tilted, y), np.nan)
    return told


def _by_user(batches: Iterator[pd.DataFrame], work: Callable[[Any], tuple[np.ndarray, ...]], key: str, names: Sequence[str], most: int = 1000) -> Iterator[pd.DataFrame]:
    """The arrays that ``work`` makes of each user's row, as rows with the user's key; ``most`` users are one frame."""
    for batch in batches:
        for at in range(0, len(batch), most):
            part = batch.iloc[at : at + most]
            told = [work(user) for user in part.itertuples(index=False)]
            each = {name: np.concatenate([t[i] for t in told]) for i, name in enumerate(names)}
            yield pd.DataFrame({key: part.iloc[:, 0].repeat([len(t[0]) for t in told]).to_numpy(), **each})


def _fit_user(user: Any) -> tuple[np.ndarray, np.ndarray]:
    """x, fit of a user with sums by temperature."""
    x = np.asarray(user.x, dtype=float)
    return x, _local_lines(x, np.asarray(user.n), np.asarray(user.w, dtype=float), np.asarray(user.wy, dtype=float), user.k)


def _on_lines(x: np.ndarray, fit: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The fits at ``g`` on the lines between points; NaN outside them."""
    left, right = np.maximum(np.searchsorted(x, g, side="right") - 1, 0), np.minimum(np.searchsorted(x, g), len(x) - 1)
    wide = np.where(left == right, 1.0, x[right] - x[left])
    return np.where((g >= x[0]) & (g <= x[-1]), fit[left] + (fit[right] - fit[left]) * (g - x[left]) / wide, np.nan)


def lowess(df: DataFrame, value: str, t: str, span: float = 2 / 3, rounds: int = 3, resolution: float = 1.0, key: str = "uid") -> DataFrame:
    """uid, x, fit: robust local regression at each temperature of a user, rounded to ``resolution``.

    A neighbourhood is the nearest ``span`` of the user's rows (two at least). After each of ``rounds``
    rounds, rows get bisquare weights by their residual in units of six times the user's median
    absolute residual, until that is next to nothing. Equal rows are counted and go through the rounds
    once. Rows are summed by (user, temperature) before the kernel, which numpy puts on a user's few
    hundred sums, however many readings; the exact median comes from ranges of the order. Nulls and
    NaN are left out.
    """
    seen = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    x = F.round(F.col(t).cast("double") / resolution) * resolution
    each = df.where(seen(value) & seen(t) & F.col(key).isNotNull()).select(F.col(key).alias("uid"), x.alias("x"), F.col(value).cast("double").alias("y"))
    rows = cut_lineage(each.groupBy("uid", "x", "y").agg(F.count(F.lit(1)).alias("c")).withColumn("r", F.lit(1.0)))
    kind, fits = dict(rows.dtypes)["uid"], None
    for done in range(rounds + 1):
        sums = rows.groupBy("uid", "x").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("r")).alias("w"), F.sum(F.col("c") * F.col("r") * F.col("y")).alias("wy"))
        users = sums.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("x", "n", "w", "wy"))).alias("points"), F.sum("n").alias("n"))
        k = F.greatest(F.least(F.floor(F.col("n") * span + 1e-7), F.col("n")), F.lit(2))
        told = users.select("uid", *[F.col("points")[c].alias(c) for c in ("x", "n", "w", "wy")], k.alias("k")).mapInPandas(lambda users: _by_user(users, _fit_user, "uid", ("x", "fit")), f"uid {kind}, x double, fit double")
        fits = cut_lineage(told if fits is None else told.join(fits.withColumnRenamed("fit", "_held"), ["uid", "x"]).select("uid", "x", F.coalesce("fit", "_held").alias("fit")))
        if done < rounds:
            off = cut_lineage(rows.join(fits, ["uid", "x"]).select("uid", "x", "y", "c", "r", F.abs(F.col("y") - F.col("fit")).alias("e")))
            gaps = off.groupBy("uid", "e").agg(F.sum("c").alias("c"))
            placed = running_sum(ordered_rank(gaps, [F.col("e")], "_place", by=["uid"]), "_place", F.col("c").cast("double"), "_upto", by=["uid"])
            sizes = off.groupBy("uid").agg(F.sum("c").alias("_n"), (F.sum(F.col("c") * F.col("e")) / F.sum("c")).alias("_mean"))
            holds = lambda place: ((F.col("_upto") - F.col("c") < place) & (place <= F.col("_upto"))).cast("int")
            middle = holds(F.floor(F.col("_n") / 2) + 1) + holds(F.floor((F.col("_n") + 1) / 2))
            scale = placed.join(sizes, "uid").groupBy("uid").agg((3 * F.sum(F.when(middle > 0, middle * F.col("e")))).alias("_six"), F.first("_mean").alias("_mean"))
            u = F.col("e") / F.col("_six")
            bisquare = F.when(F.col("_six") < 1e-7 * F.col("_mean"), F.col("r")).when(F.col("e") <= 0.001 * F.col("_six"), 1.0).when(F.col("e") <= 0.999 * F.col("_six"), (1 - u * u) * (1 - u * u)).otherwise(0.0)
            rows = cut_lineage(off.join(scale, "uid").select("uid", "x", "y", "c", bisquare.alias("r")))
    return fits.withColumnRenamed("uid", key)


def robust_response_curve(df: DataFrame, value: str, t: str, low: int, high: int, span: float = 2 / 3, rounds: int = 3, key: str = "uid") -> DataFrame:
    """uid, grid, fit, slope: :func:`lowess` at each whole degree, lines between temperatures, ends held; the slope is the step from the degree before."""
    curve = lowess(df, value, t, span, rounds, key=key).where("fit IS NOT NULL")
    points = curve.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("x", "fit"))).alias("_c"))
    grid = np.arange(low, high + 1)

    def along(user: Any) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, fit = np.asarray(user.x, dtype=float), np.asarray(user.fit, dtype=float)
        first, last = np.ceil(x[0]), np.floor(x[-1])
        # a step is known from the first whole degree within the data on; beyond, the nearest known one stands
        to = np.maximum(np.minimum(grid, last), first + 1)
        return grid, _on_lines(x, fit, np.maximum(np.minimum(grid, last), first)), _on_lines(x, fit, to) - _on_lines(x, fit, to - 1)

    users = points.select(key, F.col("_c")["x"].alias("x"), F.col("_c")["fit"].alias("fit"))
    return users.mapInPandas(lambda batches: _by_user(batches, along, key, ("grid", "fit", "slope")), f"{key} {dict(df.dtypes)[key]}, grid int, fit double, slope double")


def breakpoint_response(df: DataFrame, value: str, t: str, candidates: Sequence[float], key: str = "uid") -> DataFrame:
    """uid, break_at, slope_below, slope_above, sse: the best of the candidate breaks of y = a + b min(t - c, 0) + d max(t - c, 0).

    The candidates are exploded onto the rows and the normal equations solved
    from one aggregation; where none can be solved, slopes are 0.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(t).isNotNull()).select(key, F.col(value).cast("double").alias("y"), F.col(t).cast("double").alias("t"))
    rows = rows.withColumn("c", F.explode(F.array(*[F.lit(float(c)) for c in candidates])))
    rows = rows.select(key, "c", "y", F.least(F.col("t") - F.col("c"), F.lit(0.0)).alias("u"), F.greatest(F.col("t") - F.col("c"), F.lit(0.0)).alias("v"))
    names = {"n": F.lit(1.0), "u": F.col("u"), "v": F.col("v"), "y": F.col("y"), "uu": F.col("u") * F.col("u"), "vv": F.col("v") * F.col("v"), "uy": F.col("u") * F.col("y"), "vy": F.col("v") * F.col("y"), "yy": F.col("y") * F.col("y")}
    s = rows.groupBy(key, "c").agg(*[F.sum(e).alias(f"s_{n}") for n, e in names.items()])
    m = lambda a: F.col(f"s_{a}") / F.col("s_n")
    cov = {"uu": m("uu") - m("u") * m("u"), "vv": m("vv") - m("v") * m("v"), "uv": -m("u") * m("v"), "uy": m("uy") - m("u") * m("y"), "vy": m("vy") - m("v") * m("y"), "yy": m("yy") - m("y") * m("y")}
    s = s.select(key, "c", "s_n", *[e.alias(n) for n, e in cov.items()])
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    b = F.when(det > 1e-9, (F.col("vv") * F.col("uy") - F.col("uv") * F.col("vy")) / det)
    d = F.when(det > 1e-9, (F.col("uu") * F.col("vy") - F.col("uv") * F.col("uy")) / det)
    told = s.select(key, "c", b.alias("b"), d.alias("d"), "s_n", "yy", "uy", "vy").withColumn("sse", F.col("s_n") * (F.col("yy") - F.col("b") * F.col("uy") - F.col("d") * F.col("vy")))
    best = told.groupBy(key).agg(F.min(F.when(F.col("sse").isNotNull(), F.struct("sse", "c", "b", "d"))).alias("_b"))
    zero = lambda c: F.coalesce(F.col(f"_b.{c}"), F.lit(0.0))
    return best.select(key, F.col("_b.c").alias("break_at"), zero("b").alias("slope_below"), zero("d").alias("slope_above"), F.col("_b.sse").alias("sse"))
