"""Regime models for every household: hidden Markov regressions on temperature.

Tables in, tables out: fits come from distributed rounds of EM (:mod:`fitting`), paths
and shares from passes over chunks (:mod:`passes`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattweave.plans import fitting, passes
from wattweave.plans.chains import chi2_tail
from wattweave.plans.families import Regression, fit_families
from wattweave.storage import cut_lineage

FITTED = "uid {uid}, k int, kind string, state int, to_state int, a double, b double, sd double, loglik double, iterations int"


def fit_regimes(
    df: DataFrame, ks: Sequence[int] = (2,), obs: str = "obs", t: str = "t_d", key: str = "uid", ts: str = "ts", maxit: int = 60, restarts: int = 3, seed: int = 1, tol: float = 1e-6
) -> DataFrame:
    """uid, k, kind (response, init, transition), state, to_state, a, b, sd, loglik, iterations: a long table of fits.

    A response is a + b t with ``sd``; an initial share is a; a move's logit is
    a + b t. Rows without a temperature are left out, missing observations stay
    in with density 1. Series with fewer than 10 k observations are skipped, rows
    without a name too. EM runs from several random starts side by side
    (:mod:`fitting`); the best likelihood wins. States are sorted by slope, then
    intercept. The seed depends on the series' name, so results repeat.
    """
    sizes = df.select(F.col(key).alias("uid")).distinct().select("uid", F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
    return fitting.fit(df, sizes, max(ks), obs, t, key, ts, FITTED, maxit, tol, restarts, seed)


def split_models(fits: DataFrame, k: int | None = None) -> dict[str, DataFrame]:
    """The long table of fits as model_response, model_transition, model_init and model_perf tables."""
    rows = fits if k is None else fits.where(F.col("k") == k)
    part = lambda kind: rows.where(F.col("kind") == kind)
    return {
        "model_response": part("response").select("uid", "state", F.col("a").alias("intercept"), F.col("b").alias("slope"), "sd"),
        "model_transition": part("transition").select("uid", F.col("state").alias("from"), F.col("to_state").alias("to"), F.col("a").alias("b0"), F.col("b").alias("b1")),
        "model_init": part("init").select("uid", "state", F.col("a").alias("pi")),
        "model_perf": part("init").where("state = 1").select("uid", F.col("k").alias("n_states"), "loglik"),
    }


def decode_states(df: DataFrame, fits: DataFrame, obs: str = "obs", t: str = "t_d", key: str = "uid", ts: str = "ts", inputs: bool = False) -> DataFrame:
    """uid, ts, state, delta, gamma, fit_max, fit_avg, loglik: the likeliest path and the smoothed shares of every row; with ``inputs`` its ``t`` and ``obs`` as doubles too.

    The transition at a row is that of its own covariate, new data or old.
    ``fits`` holds one model for each user; users without one are left out, and
    so are rows without a covariate. A series of any length is spread over tasks (:mod:`passes`).
    """
    told = passes.decode(df, fits, obs, t, key, ts)
    return told.withColumnsRenamed({"x": t, "y": obs}) if inputs else told.drop("x", "y")


def model_scores(fits: DataFrame, df: DataFrame, obs: str = "obs", key: str = "uid") -> DataFrame:
    """uid, k, loglik, df (free parameters), nobs, aic, bic of every fit."""
    nobs = df.groupBy(F.col(key).alias("uid")).agg(F.count(obs).alias("nobs"))
    k = F.col("k")
    free = (3 * k + (k - 1) + 2 * k * (k - 1)).alias("df")
    return (
        fits.where("kind = 'init' AND state = 1").join(nobs, "uid").select("uid", "k", "loglik", free, "nobs")
        .withColumns({"aic": -2 * F.col("loglik") + 2 * F.col("df"), "bic": -2 * F.col("loglik") + F.log("nobs") * F.col("df")})
    )


def smooth_states(df: DataFrame, fits: DataFrame, obs: str = "obs", t: str = "t_d", key: str = "uid", ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """The forward-backward pass as tables: (uid, ts, state, gamma) of every row and state, and (uid, loglik)."""
    told = decode_states(df, fits, obs, t, key, ts)
    shares = told.select("uid", "ts", F.posexplode("gamma").alias("_s", "gamma")).select("uid", "ts", (F.col("_s") + 1).alias("state"), "gamma")
    return shares, told.groupBy("uid").agg(F.max("loglik").alias("loglik"))


def log_likelihoods(df: DataFrame, fits: DataFrame, obs: str = "obs", t: str = "t_d", key: str = "uid", ts: str = "ts") -> DataFrame:
    """uid, loglik that the forward pass gives each model, without the shares of rows."""
    return passes.likelihoods(df, fits, obs, t, key, ts)


def refit_chosen(df: DataFrame, chosen: DataFrame, obs: str = "obs", t: str = "t_d", **options) -> DataFrame:
    """The fits on all rows of the sizes that :func:`select_model_size` chose, a size for each user."""
    picked = cut_lineage(chosen.where("chosen").select("uid", "k"))
    largest = picked.agg(F.max("k")).first()[0] or 1
    options = {"maxit": 60, "tol": 1e-6, "restarts": 3, "seed": 1} | options
    return fitting.fit(df.where(F.col("uid").isNotNull()), picked, largest, obs, t, "uid", "ts", FITTED, **options)


def likelihood_ratio(scores: DataFrame, small: int, large: int) -> DataFrame:
    """uid, statistic, df, p of the model with ``large`` states against that with ``small``."""
    a, b = (scores.where(F.col("k") == k).select("uid", F.col("loglik").alias(f"l{i}"), F.col("df").alias(f"d{i}")) for i, k in enumerate((small, large)))
    out = a.join(b, "uid").select("uid", (2 * (F.col("l1") - F.col("l0"))).alias("statistic"), (F.col("d1") - F.col("d0")).alias("df"))
    return out.withColumn("p", chi2_tail(F.col("statistic"), F.col("df")))


def select_model_size(df: DataFrame, k_min: int = 1, k_max: int = 3, thr_r2: float = 0.85, thr_mape: float = 0.10, obs: str = "obs", t: str = "t_d") -> DataFrame:
    """uid, k, r2, mape, bic, chosen: fit on odd rows (``bic`` is theirs), score on even rows; the first k over a threshold, else the best R2.

    All sizes are fitted at once, as groups of their own; :func:`refit_chosen`
    then fits the chosen size on all rows.
    """
    from wattweave.operators.windows import odd_even_split

    rows = cut_lineage(odd_even_split(df.where(F.col(t).isNotNull()).select("uid", "ts", obs, t)))
    fits = cut_lineage(fit_regimes(rows.where("fold = 1"), list(range(k_min, k_max + 1)), obs, t))
    even = rows.where("fold = 0")
    scored = None
    for k in range(k_min, k_max + 1):
        one = decode_states(even, fits.where(F.col("k") == k), obs, t, inputs=True)
        e = F.col(obs) - F.col("fit_avg")
        sums = one.groupBy("uid").agg(
            F.sum(e * e).alias("sse"), (F.var_pop(obs) * F.count(obs)).alias("sst"), F.avg(F.when(F.col("fit_avg") != 0, F.abs(e / F.col("fit_avg")))).alias("mape")
        ).select("uid", F.lit(k).alias("k"), F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r2"), "mape")
        scored = sums if scored is None else scored.unionByName(sums)
    good = (F.col("r2") > thr_r2) | (F.col("mape") < thr_mape)
    w = Window.partitionBy("uid")
    first, best = F.min(F.when(good, F.col("k"))).over(w), F.max_by("k", "r2").over(w)
    scored = scored.join(model_scores(fits, rows.where("fold = 1"), obs).select("uid", "k", "bic"), ["uid", "k"], "left")
    return scored.withColumn("chosen", F.col("k") == F.coalesce(first, best))


def fit_mixture(
    df: DataFrame, k: int, y: str = "obs", x: str = "t_d", iterations: int = 20, family: str = "gaussian", hard: bool = False, tol: float = 1e-8, slopes: bool = False
) -> DataFrame:
    """state, weight, intercept, slope, sd of a mixture of regressions without time order, over all rows.

    Distributed EM: responsibilities are columns, the M-step is one aggregation
    of weighted sums. It ends when the log-likelihood rises by less than a share of
    ``tol``, or after ``iterations`` rounds. Families: gaussian (with the regression), poisson and
    binomial (0/1) with a mean only; with ``slopes`` these two, and gamma, are
    regressions too, intercept and slope on the scale of their link, sd null.
    Starts from equal slices of y by approximate quantiles.
    """
    if slopes and family != "gaussian":
        rows = df.select(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
        told = fit_families(rows, k, [Regression("y", ["x"], family)], iterations, tol)
        pick = lambda name: F.max(F.when(F.col("parameter") == name, F.col("value")))
        return told.groupBy("state", "weight").agg(pick("(intercept)").alias("intercept"), pick("x").alias("slope"), F.lit(None).cast("double").alias("sd"))

    spark, rows = df.sparkSession, df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"))
    cuts = rows.agg(F.percentile_approx("y", [(j + 0.5) / k for j in range(k)]).alias("q"), F.stddev_pop("y").alias("s")).first()
    if cuts["q"] is None:
        return spark.createDataFrame([], "state int, weight double, intercept double, slope double, sd double")
    par = [(1 / k, float(m), 0.0, max(float(cuts["s"] or 0) / k, 1e-6)) for m in cuts["q"]]
    last = -math.inf
    for _ in range(iterations):
        logs = []
        for w, a, b, s in par:
            mean = F.lit(a) + F.lit(b) * F.col("x")
            if family == "gaussian":
                d = -0.5 * ((F.col("y") - mean) / s) * ((F.col("y") - mean) / s) - math.log(s)
            elif family == "poisson":
                d = F.col("y") * math.log(max(a, 1e-9)) - max(a, 1e-9)
            else:
                p = min(max(a, 1e-9), 1 - 1e-9)
                d = F.col("y") * math.log(p) + (1 - F.col("y")) * math.log(1 - p)
            logs.append(d + math.log(max(w, 1e-300)))
        top = F.greatest(*logs) if k > 1 else logs[0]
        dense = rows.select("y", "x", top.alias("top"), *[F.exp(d - top).alias(f"e{j}") for j, d in enumerate(logs)])
        total = sum((F.col(f"e{j}") for j in range(1, k)), F.col("e0"))
        share = [F.when(F.col(f"e{j}") == F.lit(1.0), 1.0).otherwise(0.0) if hard else F.col(f"e{j}") / total for j in range(k)]
        dense = dense.select("y", "x", (F.col("top") + F.log(total)).alias("gained"), *[c.alias(f"w{j}") for j, c in enumerate(share)])
        sums = dense.agg(F.sum("gained").alias("loglik"), *[F.sum(F.col(f"w{j}") * e).alias(f"{n}{j}") for j in range(k) for n, e in (
            ("n", F.lit(1.0)), ("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("sxy", F.col("x") * F.col("y")), ("syy", F.col("y") * F.col("y")))]).first()
        if sums["loglik"] - last <= tol * abs(sums["loglik"]):
            break
        last = sums["loglik"]
        n_all, par = sum(sums[f"n{j}"] for j in range(k)), []
        for j in range(k):
            n, sx, sy, sxx, sxy, syy = (sums[f"{v}{j}"] for v in ("n", "sx", "sy", "sxx", "sxy", "syy"))
            n = max(n, 1e-9)
            det = sxx - sx * sx / n
            b = (sxy - sx * sy / n) / det if family == "gaussian" and det > 1e-9 else 0.0
            a = (sy - b * sx) / n
            s2 = max((syy - 2 * a * sy - 2 * b * sxy + n * a * a + 2 * a * b * sx + b * b * sxx) / n, 1e-12)
            par.append((n / n_all, a, b, math.sqrt(s2)))
    par.sort(key=lambda p: (p[2], p[1]))
    return spark.createDataFrame([(j + 1, *p) for j, p in enumerate(par)], "state int, weight double, intercept double, slope double, sd double")
