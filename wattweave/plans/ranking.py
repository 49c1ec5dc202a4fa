"""Agreement of rankings: Kendall's tau at k, response tiers, distance to a reference ranking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattweave.spread import ordered_rank
from wattweave.storage import cut_lineage


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    return erfc(x)


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, by a fixed rational approximation (error below 2e-7)."""
    t = 1 / (1 + 0.5 * x)
    # The coefficients of the approximation, constant term first.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[-1])
    for a in reversed(c[:-1]):
        poly = F.lit(a) + t * poly
    return t * F.exp(-x * x + poly)


def kendall_tau_at_k(df: DataFrame, ks: Sequence[int], model: str = "model", truth: str = "truth", by: Sequence[str] = (), tie: str = "uid", alpha: float = 0.05) -> DataFrame:
    """by, k, n, tau, p of the model's top k against the truth; tau is 0 where p exceeds ``alpha``.

    Pairs are made among the largest k only, which is bounded; p is the normal
    approximation.
    """
    part = [F.col(c) for c in by] or [F.lit(0)]
    rank = F.row_number().over(Window.partitionBy(*part).orderBy(F.abs(F.col(model)).desc(), F.col(tie)))
    top = df.withColumn("_r", rank).where(F.col("_r") <= max(ks)).select(*by, "_r", F.abs(F.col(model)).alias("_m"), F.abs(F.col(truth)).alias("_t"))
    lists = top.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", "_m", "_t"))).alias("_l"))  # max(ks) rows
    sized = lists.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn("_l", F.slice("_l", F.lit(1), F.col("k")))
    pairs = F.aggregate(
        "_l", F.lit(0.0),
        lambda s, a: s + F.aggregate("_l", F.lit(0.0), lambda u, b: u + F.when(b["_r"] > a["_r"], F.signum(b["_m"] - a["_m"]) * F.signum(b["_t"] - a["_t"])).otherwise(0.0)),
    )
    n = F.size("_l").cast("double")
    told = sized.select(*by, "k", n.alias("n"), pairs.alias("s"))
    tau = F.when(F.col("n") > 1, F.col("s") / (F.col("n") * (F.col("n") - 1) / 2))
    z = 3 * F.col("tau") * F.sqrt(F.col("n") * (F.col("n") - 1)) / F.sqrt(2 * (2 * F.col("n") + 5))
    out = told.withColumn("tau", tau).withColumn("p", normal_tail(z))
    return out.select(*by, "k", F.col("n").cast("long").alias("n"), F.when(F.col("p") <= alpha, F.col("tau")).otherwise(F.when(F.col("tau").isNotNull(), 0.0)).alias("tau"), "p")


def response_tiers(df: DataFrame, col: str = "tau", bounds: tuple[float, float] = (0.33, 0.6)) -> DataFrame:
    """Adds ``tier``: low below the first bound, high from the second on, else medium."""
    return df.withColumn("tier", F.when(F.col(col) < bounds[0], "low").when(F.col(col) < bounds[1], "medium").when(F.col(col).isNotNull(), "high"))


def normalise_rows(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``relative``: the absolute value's share of the largest of its row group, or of the whole table."""
    if not by:
        top = df.agg(F.max(F.abs(F.col(value))).alias("_top"))  # one row
        joined = df.crossJoin(F.broadcast(top))
    else:
        joined = df.join(df.groupBy(*by).agg(F.max(F.abs(F.col(value))).alias("_top")), list(by))
    return joined.withColumn("relative", F.when(F.col("_top") > 0, F.col(value) / F.col("_top"))).select(*df.columns, "relative")


def _distances(means: np.ndarray, covariance: np.ndarray, orders: np.ndarray, n: int, sweeps: int = 3000) -> np.ndarray:
    """The distance of each order (rows of item places) to scores with these means and this covariance.

    With m the differences of neighbours in the order and S their covariance,
    the least n (x - m)' S^-1 (x - m) over x >= 0, as n z' S z with z >= 0,
    S z + m >= 0 and the two complementary; solved for all orders together by
    coordinate steps.
    """
    a, b = orders[:, :-1], orders[:, 1:]
    m = means[a] - means[b]
    c = lambda x, y: covariance[x[:, :, None], y[:, None, :]]
    s = c(a, a) - c(a, b) - c(b, a) + c(b, b) + 1e-5 * np.eye(a.shape[1])
    z = np.zeros_like(m)
    for _ in range(sweeps):
        moved = 0.0
        for i in range(m.shape[1]):
            new = np.maximum(0.0, z[:, i] - (m[:, i] + np.einsum("bj,bj->b", s[:, i], z)) / s[:, i, i])
            moved = max(moved, np.abs(new - z[:, i]).max())
            z[:, i] = new
        if moved <= 1e-10 * (1 + np.abs(z).max()):
            break
    return np.sqrt(np.maximum(n * np.einsum("bi,bij,bj->b", z, s, z), 0.0))


def drank(scores: DataFrame, truth: DataFrame, ks: Sequence[int], replicates: int = 200, seed: int = 1, key: str = "uid") -> DataFrame:
    """k, distance, p of the true ranking's first k items against replicated scores.

    ``scores(rep, uid, score)`` with a score of every item in every replicate,
    ``truth(uid, rank)``. Distance is that of the mean differences between
    neighbours of the ranking, scaled by their covariance over the replicates,
    to the nearest means that the ranking would hold for; p the share of
    bootstrap resamples of the replicates whose own ranking is no nearer.
    Replicates and resamples are rows: a resample draws replicates by a hash, its means are an
    aggregation, and a row holds one order of max(ks) items at most. Means and covariance of each k reach the driver.
    """
    spark = scores.sparkSession
    items = truth.where(F.col("rank") <= max(ks)).select(F.col(key).cast("string").alias("_item"), "rank")
    rows = scores.select(F.col(key).cast("string").alias("_item"), F.col("rep").cast("string").alias("_rep"), "score").join(items, "_item")
    rows = rows.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks]))).where((F.col("rank") <= F.col("k")) & F.col("_rep").isNotNull())
    # the mean of repeated scores; replicates that lack an item are left out
    once = cut_lineage(rows.groupBy("k", "_rep", "rank").agg(F.avg("score").alias("score")).where("score IS NOT NULL AND NOT isnan(score)"))
    wanted = once.groupBy("k").agg(F.countDistinct("rank").alias("_items"))
    whole = once.groupBy("k", "_rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"].cast("double")).alias("x")).join(wanted, "k").where(F.size("x") == F.col("_items"))
    placed = cut_lineage(ordered_rank(whole.select("k", "_rep", "x"), [F.col("_rep")], "_at", by=["k"]))
    sizes = {r["k"]: (r["n"], r["m"]) for r in placed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("m")).collect()}
    good = [k for k, (n, m) in sizes.items() if n >= 2 and m >= 2]
    rest = spark.createDataFrame([(int(k), None, None) for k in {r["k"] for r in wanted.collect()} if k not in good], "k int, distance double, p double")
    if not good:
        return rest
    kept = placed.where(F.col("k").isin(good))
    each = kept.select("k", "x", F.posexplode("x").alias("i", "xi"))
    means = {k: np.zeros(sizes[k][1]) for k in good}
    for r in each.groupBy("k", "i").agg(F.avg("xi").alias("m")).collect():
        means[r["k"]][r["i"]] = r["m"]
    covariance = {k: np.zeros((sizes[k][1], sizes[k][1])) for k in good}
    pairs = each.select("k", "i", "xi", F.posexplode("x").alias("j", "xj")).where("j <= i")
    for r in pairs.groupBy("k", "i", "j").agg(F.covar_samp("xi", "xj").alias("c")).collect():  # k x k numbers
        covariance[r["k"]][r["i"], r["j"]] = covariance[r["k"]][r["j"], r["i"]] = r["c"]
    each_size = spark.createDataFrame([(int(k), sizes[k][0]) for k in good], "k int, n long")
    draws = each_size.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    drawn = draws.withColumn("_at", F.pmod(F.xxhash64(F.lit(seed), "k", "b", "j"), F.col("n")) + 1).groupBy("k", "b", "_at").agg(F.count(F.lit(1)).alias("c"))
    mean = drawn.join(kept.select("k", "_at", "x"), ["k", "_at"]).select("k", "b", "c", F.posexplode("x").alias("i", "v")).groupBy("k", "b", "i").agg(F.sum(F.col("c") * F.col("v")).alias("s"))
    ordered = mean.groupBy("k", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("s"), "i"))), lambda p: p["i"]).alias("order"))
    true = spark.createDataFrame([(int(k), 0, list(range(sizes[k][1]))) for k in good], "k int, b int, order array<int>")

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, own in pdf.groupby("k"):
                d = _distances(means[k], covariance[k], np.stack(own["order"].to_numpy()), sizes[k][0])
                yield pd.DataFrame({"k": own["k"], "b": own["b"], "d": d})

    told = cut_lineage(true.unionByName(ordered).mapInPandas(distances, "k int, b int, d double"))
    own = told.where("b = 0").select("k", F.col("d").alias("distance"))
    out = told.where("b > 0").join(F.broadcast(own), "k").groupBy("k", "distance").agg(F.avg((F.col("d") >= F.col("distance")).cast("double")).alias("p"))
    return out.select("k", "distance", "p").unionByName(rest)
