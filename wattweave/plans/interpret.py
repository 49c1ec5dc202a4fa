"""What fitted regimes mean: transitions, stationary shares, durations, labels, profiles. DataFrame expressions, but for matrix powers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattweave.functions.vectors import vector_sum
from wattweave.spread import small

# Left-closed slope intervals of the thermal labels.
SLOPES = (-2.0, -0.025, 0.025, 2.0)
THERMAL = ("H.Hi", "H.Lo", "N", "C.Lo", "C.Hi")


def transition_matrix_at(tran: DataFrame, grid: DataFrame, t: str = "t") -> DataFrame:
    """uid, t, from, to, p: softmax over ``to`` of b0 + b1 t, for each temperature of the (small) grid."""
    score = tran.crossJoin(small(grid.select(t))).withColumn("_z", F.col("b0") + F.col("b1") * F.col(t))
    w = Window.partitionBy("uid", "from", t)
    e = F.exp(F.col("_z") - F.max("_z").over(w))
    return score.withColumn("_e", e).select("uid", t, "from", "to", (F.col("_e") / F.sum("_e").over(w)).alias("p"))


def _matrix(p: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, m: the K x K matrix of (from, to, p) as an array of rows."""
    rows = p.groupBy(*keys, "from").agg(F.transform(F.array_sort(F.collect_list(F.struct("to", "p"))), lambda s: s["p"]).alias("_r"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("from", "_r"))), lambda s: s["_r"]).alias("m"))


def row_times(v: Column, m: Column) -> Column:
    """Row vector times matrix (array of rows)."""
    k = F.size(v)
    return F.transform(
        F.sequence(F.lit(1), k),
        lambda j: F.aggregate(F.zip_with(v, m, lambda x, row: x * F.element_at(row, j)), F.lit(0.0), lambda s, x: s + x),
    )


def _limits(batches: Iterator[pa.RecordBatch], squarings: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            k = round(float(size) ** 0.5)
            if k * k != size or not k:
                raise ValueError(f"a matrix of {size} probabilities is not square")
            m = (flat[starts[rows][:, None] + np.arange(size)].reshape(-1, k, k) + np.eye(k)) / 2
            for _ in range(squarings):
                m = m @ m
            pi = m.mean(axis=1)
            pi /= pi.sum(axis=1, keepdims=True)  # squaring lets the scale drift a little
            at = pa.array(np.repeat(rows, k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(pi.ravel())],
                names=[*batch.schema.names[:2], "state", "pi"],
            )


def stationary_distribution(p: DataFrame, t: str = "t", squarings: int = 30) -> DataFrame:
    """uid, t, state, pi: the limit of the lazy chain (I + P) / 2, by repeated squaring of all matrices of an Arrow batch at once.

    The lazy chain has the same stationary distribution and always converges,
    also where P alternates; with several closed classes the result starts from
    the uniform distribution. ``p`` holds all K x K moves of each uid and t.
    """
    cells = F.array_sort(F.collect_list(F.struct("from", "to", "p")))
    mats = p.groupBy("uid", t).agg(F.transform(cells, lambda s: s["p"].cast("double")).alias("m"))
    kinds = dict(p.dtypes)
    return mats.mapInArrow(lambda batches: _limits(batches, squarings), f"uid {kinds['uid']}, {t} {kinds[t]}, state int, pi double")


def response_by_degree(stationary: DataFrame, resp: DataFrame, t: str = "t", value: str = "slope", spread: str = "se_slope") -> DataFrame:
    """uid, t, mean_response, mean_se, map_response, map_se: response and its error weighted by the stationary shares of a degree, and those of its likeliest state."""
    rows = stationary.join(resp.select("uid", "state", F.col(value).alias("_v"), F.col(spread).alias("_s")), ["uid", "state"])
    likeliest = F.max_by(F.struct("_v", "_s"), F.struct(F.round("pi", 9), -F.col("state")))
    return rows.groupBy("uid", t).agg(
        F.sum(F.col("pi") * F.col("_v")).alias("mean_response"), F.sum(F.col("pi") * F.col("_s")).alias("mean_se"), likeliest.alias("_m")
    ).select("uid", t, "mean_response", "mean_se", F.col("_m._v").alias("map_response"), F.col("_m._s").alias("map_se"))


def expected_duration(p: DataFrame, t: str = "t") -> DataFrame:
    """uid, t, state, tau = 1 / (1 - p_jj); null for a state that is never left."""
    stay = p.where(F.col("from") == F.col("to"))
    return stay.select("uid", t, F.col("from").alias("state"), F.when(F.col("p") < 1, 1 / (1 - F.col("p"))).alias("tau"))


def regime_labels(resp: DataFrame) -> DataFrame:
    """uid, state, thermal (by slope), activity (High where sd / intercept exceeds one half)."""
    thermal = F.lit(THERMAL[0])
    for bound, label in zip(SLOPES, THERMAL[1:], strict=True):
        thermal = F.when(F.col("slope") >= bound, label).otherwise(thermal)
    high = F.col("sd") / F.when(F.col("intercept") != 0, F.col("intercept")) > 0.5
    return resp.select("uid", "state", thermal.alias("thermal"), F.when(F.coalesce(high, F.lit(False)), "High").otherwise("Low").alias("activity"))


def map_and_mean_response(decoded: DataFrame, resp: DataFrame, t: str = "t_d") -> DataFrame:
    """uid, ts, map_response (of the chosen state), mean_response (weighted by delta), each row with its own weights."""
    lines = resp.groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("state", F.struct("intercept", "slope")))).alias("_m"))
    line = lambda i: F.element_at("_m", i)["intercept"] + F.element_at("_m", i)["slope"] * F.col(t)
    cells = F.transform("delta", lambda w, i: F.struct((i + 1).alias("s"), w.alias("w"), line(i + 1).alias("v")))
    rows = decoded.join(lines, "uid").withColumn("_c", F.filter(cells, lambda c: F.map_contains_key("_m", c["s"]))).where(F.size("_c") > 0)
    mean = F.try_divide(vector_sum(F.transform("_c", lambda c: c["w"] * c["v"])), vector_sum(F.transform("_c", lambda c: c["w"])))
    known = F.exists("_c", lambda c: (c["w"] * c["v"]).isNotNull())
    return rows.select("uid", "ts", line(F.col("state")).alias("map_response"), F.when(known, mean).alias("mean_response"))


def propagate_state_distribution(init: DataFrame, p: DataFrame, step: str = "hour") -> DataFrame:
    """uid, hour, dist: p_h = p_(h-1) A_h over the steps in order; ``init(uid, state, pi)`` stands before the first.

    The fold runs over one user's row of step matrices; a forecast has 24.
    """
    start = init.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("state", "pi"))), lambda s: s["pi"].cast("double")).alias("_pi"))
    mats = _matrix(p, ["uid", step]).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(step, "m"))).alias("_m"))
    kind = f"array<struct<{step}:{dict(p.dtypes)[step]},dist:array<double>>>"
    zero = F.struct(F.col("_pi").alias("v"), F.array().cast(kind).alias("out"))

    def fold(acc: Column, x: Column) -> Column:
        v = row_times(acc["v"], x["m"])
        return F.struct(v.alias("v"), F.concat(acc["out"], F.array(F.struct(x[step].alias(step), v.alias("dist")))).alias("out"))

    done = start.join(mats, "uid").select("uid", F.aggregate("_m", zero, fold, lambda acc: acc["out"]).alias("o"))
    return done.select("uid", F.explode("o").alias("o")).select("uid", f"o.{step}", "o.dist")


def profile_moments(dist: DataFrame, resp: DataFrame, step: str = "hour", value: str = "slope", spread: str = "se_slope") -> DataFrame:
    """uid, hour, mu, sd of the mixture of states in each hour."""
    rows = dist.select("uid", step, F.posexplode("dist").alias("_s", "w")).withColumn("state", F.col("_s") + 1).join(resp, ["uid", "state"])
    mu = F.sum(F.col("w") * F.col(value))
    second = F.sum(F.col("w") * (F.col(value) * F.col(value) + F.col(spread) * F.col(spread)))
    return rows.groupBy("uid", step).agg(mu.alias("mu"), F.sqrt(F.greatest(second - mu * mu, F.lit(0.0))).alias("sd"))


def _step_covariances(h1: np.ndarray, dist: np.ndarray, h2: np.ndarray, m: np.ndarray, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h1, h2, covariance of a user's steps h1 < h2: all starts go through each step's matrix together."""
    d = np.asarray(dist, dtype=float).reshape(len(h1), -1)
    k = d.shape[1]
    mats, means = np.asarray(m, dtype=float).reshape(len(h2), k, k), np.full(k, np.nan)
    means[: min(k, len(mu))] = np.asarray(mu, dtype=float)[:k]
    own, v = d @ means, d * means
    d, out = d.copy(), []
    for h, a in zip(h2, mats, strict=True):
        n = int(np.searchsorted(h1, h))  # starts before this step
        v[:n], d[:n] = v[:n] @ a, d[:n] @ a
        out.append((h1[:n], np.full(n, h), v[:n] @ means - own[:n] * (d[:n] @ means)))
    told = [np.concatenate(parts) for parts in zip(*out, strict=True)]
    return told[0], told[1], told[2]


def profile_covariance(dist: DataFrame, p: DataFrame, resp: DataFrame, step: str = "hour", value: str = "slope", compat: bool = False) -> DataFrame:
    """uid, h1, h2, cov between hours h1 < h2 of the state means.

    P(state at h1, state at h2) follows from the step matrices between them.
    ``compat=True`` halves the result, as when one triangle is averaged with an
    empty transpose.
    """
    mats = _matrix(p, ["uid", step]).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(step, "m"))).alias("_m"))
    means = resp.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("state", value))), lambda s: s[value].cast("double")).alias("mu"))
    starts = dist.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(step, "dist"))).alias("_d"))
    whole = lambda c: F.transform(c, lambda x: x[step].cast("long"))
    users = starts.join(mats, "uid").join(means, "uid").select(
        "uid", whole("_d").alias("h1"), F.flatten(F.transform("_d", lambda x: x["dist"])).alias("dist"),
        whole("_m").alias("h2"), F.flatten(F.transform("_m", lambda x: F.flatten(x["m"]))).alias("m"), "mu",
    )
    factor = 0.5 if compat else 1.0

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = [_step_covariances(*row[1:]) for row in batch.itertuples(index=False)]
            if told:
                h1, h2, c = (np.concatenate(parts) for parts in zip(*told, strict=True))
                yield pd.DataFrame({"uid": batch["uid"].repeat([len(t[0]) for t in told]).to_numpy(), "h1": h1, "h2": h2, "cov": factor * c})

    return users.mapInPandas(work, f"uid {dict(dist.dtypes)['uid']}, h1 long, h2 long, cov double")


def propagated(models: dict[str, DataFrame], forecast: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The step matrices of a forecast of (hour, t), and the shares of states that follow from them."""
    p = transition_matrix_at(models["model_transition"], forecast.select("t").distinct()).join(small(forecast), "t")
    return p, propagate_state_distribution(models["model_init"], p)


def compute_profiles(models: dict[str, DataFrame], forecast: DataFrame) -> DataFrame:
    """uid, hour, kind (slope, baseload, volatility), mu, sd of every user over a forecast of (hour, t).

    ``model_response`` holds intercept, slope, sd and the standard errors
    se_intercept and se_slope. Volatility has mean 0 and the spread of the
    states' residuals.
    """
    _, dist = propagated(models, forecast)
    resp = models["model_response"].withColumn("_zero", F.lit(0.0))
    kinds = {"slope": ("slope", "se_slope"), "baseload": ("intercept", "se_intercept"), "volatility": ("_zero", "sd")}
    parts = [profile_moments(dist, resp, value=v, spread=e).withColumn("kind", F.lit(k)) for k, (v, e) in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def compute_profile_covariances(models: dict[str, DataFrame], forecast: DataFrame, compat: bool = False) -> DataFrame:
    """uid, kind (slope, baseload), h1, h2, cov for all hours h1 <= h2 of a forecast; on the diagonal the variance of :func:`compute_profiles`."""
    p, dist = propagated(models, forecast)
    resp, out = models["model_response"], None
    for kind, value, spread in (("slope", "slope", "se_slope"), ("baseload", "intercept", "se_intercept")):
        own = profile_moments(dist, resp, value=value, spread=spread).select("uid", F.col("hour").cast("long").alias("h1"), F.col("hour").cast("long").alias("h2"), (F.col("sd") * F.col("sd")).alias("cov"))
        one = profile_covariance(dist, p, resp, value=value, compat=compat).unionByName(own).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


def detect_state_labels(decoded: DataFrame, theta_m: float, theta_t: float) -> DataFrame:
    """Adds home, hvac (model) and home_true, hvac_true.

    Model: a state's sd, and absolute slope, over the user's least one exceed
    ``theta_m``. Truth: the row's user and hvac kWh exceed the user's
    ``theta_t`` quantile of them.
    """
    w = Window.partitionBy("uid")
    over = {"_sd": F.min("sd"), "_slope": F.min(F.abs("slope")), "_qu": F.percentile("user", theta_t), "_qh": F.percentile("hvac", theta_t)}
    told = decoded.where("uid IS NOT NULL").withColumns({name: bound.over(w) for name, bound in over.items()})
    home, hvac = F.col("sd") > theta_m * F.col("_sd"), F.abs("slope") > theta_m * F.col("_slope")
    return told.withColumns({"home": home, "hvac_on": hvac, "home_true": F.col("user") > F.col("_qu"), "hvac_true": F.col("hvac") > F.col("_qh")}).drop(*over)


def state_standard_errors(states: DataFrame, x: str, y: str, keys: Sequence[str] = ("uid", "state")) -> DataFrame:
    """keys, n, intercept, slope, se_intercept, se_slope, sigma of y on x within each key; null where not determined."""
    s = states.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy")
    )
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx"))
    out = s.withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    var = F.when(F.col("n") > 2, F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2))
    return out.withColumn("_v", var).select(
        *keys, "n", "intercept", "slope",
        F.sqrt(F.col("_v") * (1 / F.col("n") + F.col("mx") * F.col("mx") / F.col("sxx"))).alias("se_intercept"),
        F.sqrt(F.col("_v") / F.col("sxx")).alias("se_slope"), F.sqrt("_v").alias("sigma"),
    )


def temperature_state_profile(states: DataFrame, value: str = "temperature_f", low: int = 1, high: int = 120, width: int = 1) -> DataFrame:
    """uid, grid, state, share: the states of the rows within ``width`` degrees of each grid degree."""
    from wattweave.operators.joins import band_join

    n = band_join(states, value, low, high, width).groupBy("uid", "grid", "state").agg(F.count(F.lit(1)).alias("n"))
    return n.select("uid", "grid", "state", (F.col("n") / F.sum("n").over(Window.partitionBy("uid", "grid"))).alias("share"))


def residual_summary(decoded: DataFrame, obs: str = "obs", fit: str = "fit", keys: Sequence[str] = ("uid",)) -> DataFrame:
    """keys (user, or user and state), n, mape (over the fit), r2, rmse, and the Jarque-Bera statistic of the residuals."""
    r = F.col(obs) - F.col(fit)
    out = decoded.where(r.isNotNull()).withColumn("_r", r).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col(fit) != 0, F.abs(r / F.col(fit)))).alias("mape"), F.sum(r * r).alias("_sse"),
        (F.var_pop(obs) * F.count(obs)).alias("_sst"), F.skewness("_r").alias("_g"), F.kurtosis("_r").alias("_k"),
    )
    jb = F.col("n") / 6 * (F.col("_g") * F.col("_g") + F.col("_k") * F.col("_k") / 4)
    return out.select(*keys, "n", "mape", F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst")).alias("r2"), F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"), jb.alias("jarque_bera"))
