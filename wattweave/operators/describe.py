"""Aggregates that describe consumption, states and detections."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import is_complete
from .reshape import melt


def mean_by(df: DataFrame, keys: Sequence[str], cols: Sequence[str], complete_cases: bool = False) -> DataFrame:
    """keys, variable, mean: of each column, over complete rows only where asked."""
    rows = df.where(is_complete(cols)) if complete_cases else df
    return melt(rows, list(keys), list(cols)).groupBy(*keys, "variable").agg(F.avg("value").alias("mean"))


def residual_nonhvac(df: DataFrame, parts: Sequence[str] = ("user", "lights", "always_on", "scheduled")) -> DataFrame:
    """Adds ``residual``: nonHVAC less the end uses that are columns (nulls count 0)."""
    out = F.col("nonHVAC")
    for c in parts:
        if c in df.columns:
            out = out - F.coalesce(F.col(c), F.lit(0.0))
    return df.withColumn("residual", out)


def on_fraction(df: DataFrame, keys: Sequence[str], cols: tuple[str, str] = ("C", "H")) -> DataFrame:
    """Share of complete hours with each of two uses on, and with both."""
    a, b = (F.col(c) > 0 for c in cols)
    share = lambda c, name: F.avg(c.cast("double")).alias(name)
    return df.where(is_complete(cols)).groupBy(*keys).agg(share(a, f"{cols[0]}_on"), share(b, f"{cols[1]}_on"), share(a & b, "both_on"))


def seasonal_ratio(means: DataFrame, key: str = "uid") -> DataFrame:
    """variable, winter, summer, ratio from (uid, season, variable, mean): means over users, winter over summer."""
    wide = means.groupBy("variable").agg(
        F.avg(F.when(F.col("season") == "Winter", F.col("mean"))).alias("winter"), F.avg(F.when(F.col("season") == "Summer", F.col("mean"))).alias("summer")
    )
    ratio = F.when(F.col("summer") != 0, F.col("winter") / F.col("summer"))
    side = F.when(ratio < 0.8, "summer").when(ratio > 1.2, "winter").when(ratio.isNotNull(), "even")
    return wide.withColumns({"ratio": ratio, "side": side})


def end_use_coverage(df: DataFrame, end_use: str = "category", key: str = "uid") -> DataFrame:
    """Share of all users that are monitored for each end use."""
    users = df.select(F.countDistinct(key).alias("_n"))
    return df.groupBy(end_use).agg(F.countDistinct(key).alias("n_users")).crossJoin(F.broadcast(users)).select(end_use, "n_users", (F.col("n_users") / F.col("_n")).alias("share"))


def state_share(states: DataFrame, key: str = "uid", state: str = "state") -> DataFrame:
    """key, state, share of the key's rows."""
    n = states.groupBy(key, state).agg(F.count(F.lit(1)).alias("n"))
    return n.select(key, state, (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("share"))


def state_share_by(states: DataFrame, by: Column, key: str = "uid", state: str = "state") -> DataFrame:
    """uid, key, state, share within (uid, key); combinations that don't occur are 0."""
    n = states.groupBy(key, by.alias("key"), state).agg(F.count(F.lit(1)).alias("n"))
    cells = n.select(key, "key").distinct().join(n.select(key, state).distinct(), key)
    full = cells.join(n, [key, "key", state], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select(key, "key", state, (F.col("n") / F.sum("n").over(Window.partitionBy(key, "key"))).alias("share"))


def state_breakdown(states: DataFrame, hour: Column, season: Column, state: str = "state") -> DataFrame:
    return states.groupBy(hour.alias("hour"), season.alias("season"), state).agg(F.count(F.lit(1)).alias("n"))


def state_heatmap(df: DataFrame, value: str, key: str = "uid", ts: str = "ts") -> DataFrame:
    """uid, day and a column ``h0..h23``: the mean of the value in the hour."""
    return df.groupBy(key, F.to_date(ts).alias("day")).agg(*[F.avg(F.when(F.hour(ts) == h, F.col(value))).alias(f"h{h}") for h in range(24)])


def contributions(states: DataFrame, params: DataFrame, covariates: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Mean of coefficient x covariate in each group; ``params(uid, state, covariate, beta)``; covariate "intercept" counts 1."""
    long = melt(states.withColumn("intercept", F.lit(1.0)), ["uid", "state", *by], ["intercept", *covariates]).withColumnRenamed("variable", "covariate")
    return (
        long.join(params, ["uid", "state", "covariate"])
        .groupBy("uid", *by, "covariate")
        .agg(F.avg(F.col("beta") * F.col("value")).alias("contribution"))
    )


def confusion_metrics(df: DataFrame, model: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, fn, tn, fp and balanced accuracy of a boolean against the truth; null where a class is missing."""
    n = lambda m, t, name: F.sum(((F.col(model) == m) & (F.col(truth) == t)).cast("long")).alias(name)
    out = df.groupBy(*by).agg(n(True, True, "tp"), n(False, True, "fn"), n(False, False, "tn"), n(True, False, "fp"))
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return out.withColumn("balanced_accuracy", (rate("tp", "fn") + rate("tn", "fp")) / 2)


def joint_state_tables(df: DataFrame, first: str, second: str, match: str | None = None) -> DataFrame:
    """Share, and rate of ``match`` where given, of each of the four cells of two booleans; absent cells are 0."""
    total = F.count(F.lit(1))
    aggs = []
    for a in (False, True):
        for b in (False, True):
            cell = (F.col(first) == a) & (F.col(second) == b)
            n = F.sum(cell.cast("double"))
            hit = F.sum((cell & F.col(match)).cast("double")) if match else F.lit(None).cast("double")
            aggs.append(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), (n / total).alias("share"), F.when(n > 0, hit / n).alias("match_rate")))
    return df.agg(F.array(*aggs).alias("_c")).select(F.explode("_c").alias("c")).select("c.*")


def detection_sweep(hours: DataFrame, thetas_m: Sequence[float], thetas_t: Sequence[float], model: str = "ratio", truth: str = "kwh", key: str = "uid") -> DataFrame:
    """uid, theta_m, theta_t, balanced_accuracy: model ratio over theta_m against truth over its theta_t quantile.

    The grid of thresholds is exploded onto each row, so that one aggregation
    serves all of it.
    """
    grid = [(float(m), float(t), i) for m in thetas_m for i, t in enumerate(thetas_t)]
    bounds = hours.groupBy(key).agg(F.percentile(truth, F.array(*[F.lit(float(t)) for t in thetas_t])).alias("_q"))
    cells = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(t).alias("t"), F.lit(i).alias("i")) for m, t, i in grid])
    rows = hours.join(bounds, key).select(key, model, truth, "_q", F.explode(cells).alias("c"))
    told = rows.select(
        key, F.col("c.m").alias("theta_m"), F.col("c.t").alias("theta_t"), (F.col(model) > F.col("c.m")).alias("_m"), (F.col(truth) > F.element_at("_q", F.col("c.i") + 1)).alias("_t")
    )
    return confusion_metrics(told, "_m", "_t", [key, "theta_m", "theta_t"]).select(key, "theta_m", "theta_t", "balanced_accuracy")


def detection_tables(hours: DataFrame, thetas_m: Sequence[float], thetas_t: Sequence[float], uses: Sequence[tuple[str, str]], key: str = "uid") -> DataFrame:
    """theta_m, theta_t, first, second, model, truth, match: joint tables of two detections, as means over users.

    ``uses`` names (model ratio, true kWh) of each of the two. In a cell
    (first on, second on) ``model`` is the share of a user's hours that the model
    puts there, ``truth`` that of the true states, ``match`` the share of the
    latter that the model puts there too (users without such hours aside). The
    thresholds are exploded onto each row.
    """
    probs = F.array(*[F.lit(float(t)) for t in thetas_t])
    bounds = hours.groupBy(key).agg(*[F.percentile(t, probs).alias(f"_q{i}") for i, (_, t) in enumerate(uses)])
    cells = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(t)).alias("t"), F.lit(i).alias("i")) for m in thetas_m for i, t in enumerate(thetas_t)])
    rows = hours.join(bounds, key).withColumn("c", F.explode(cells))
    on = {f"m{i}": F.col(m) > F.col("c.m") for i, (m, _) in enumerate(uses)} | {f"t{i}": F.col(t) > F.element_at(f"_q{i}", F.col("c.i") + 1) for i, (_, t) in enumerate(uses)}
    told = rows.select(key, F.col("c.m").alias("theta_m"), F.col("c.t").alias("theta_t"), *[c.alias(n) for n, c in on.items()])
    share = lambda c: F.avg(c.cast("double"))
    out = []
    for a in (False, True):
        for b in (False, True):
            model, truth = (F.col("m0") == a) & (F.col("m1") == b), (F.col("t0") == a) & (F.col("t1") == b)
            out.append(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), share(model).alias("model"), share(truth).alias("truth"), F.avg(F.when(truth, model.cast("double"))).alias("match")))
    users = told.groupBy(key, "theta_m", "theta_t").agg(F.array(*out).alias("_c")).select("theta_m", "theta_t", F.explode("_c").alias("c")).select("theta_m", "theta_t", "c.*")
    return users.groupBy("theta_m", "theta_t", "first", "second").agg(*[F.avg(c).alias(c) for c in ("model", "truth", "match")])


def sweep_pivot(sweep: DataFrame, thetas_m: Sequence[float], value: str = "balanced_accuracy") -> DataFrame:
    """theta_t and a column for each theta_m (``m_<value>``): the mean over users of a :func:`detection_sweep`."""
    wide = sweep.groupBy("theta_t").pivot("theta_m", [float(m) for m in thetas_m]).agg(F.avg(value))
    return wide.withColumnsRenamed({str(float(m)): f"m_{m:g}".replace(".", "_") for m in thetas_m})


def distribution_summary(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """n, mean, sd and exact (interpolated) quantiles (array ``q``) by group.

    Groups may hold most of the table, so values aren't gathered by group: they
    are ranked by ranges of (group, value), and only the two neighbours of each
    quantile are kept.
    """
    from wattweave.spread import ordered_rank

    sums = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    ranked = ordered_rank(df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")), [F.col("_v")], "_i", by)
    at = lambda p: (F.col("n") - 1) * F.lit(float(p))
    near = [F.max(F.when(F.col("_i") == F.floor(at(p)) + 1, F.col("_v"))).alias(f"a{j}") for j, p in enumerate(probs)] + [F.max(F.when(F.col("_i") == F.ceil(at(p)) + 1, F.col("_v"))).alias(f"b{j}") for j, p in enumerate(probs)]
    kept = ranked.join(sums.select(*by, "n"), list(by)).groupBy(*by).agg(F.max("n").alias("n"), *near)
    q = F.array(*[F.col(f"a{j}") + (F.col(f"b{j}") - F.col(f"a{j}")) * (at(p) - F.floor(at(p))) for j, p in enumerate(probs)])
    return sums.join(kept.select(*by, q.alias("q")), list(by), "left")


def densities(df: DataFrame, by: Sequence[str], value: str, low: float, high: float, bins: int = 64, bandwidth: float | None = None) -> DataFrame:
    """by, bin, x, n, density: counts in equal bins of [low, high) and their smooth density at the bins' middles.

    The kernel is Gaussian, of ``bandwidth`` (two bins if none is given); values
    outside count in the first and last bin. Rows are counted by (group, bin) first, so the kernel
    sees ``bins`` numbers a group. Nulls and NaNs are left out.
    """
    width = (high - low) / bins
    h = 2 * width if bandwidth is None else bandwidth
    v = F.col(value).cast("double")
    at = F.greatest(F.least(F.floor((v - low) / width), F.lit(bins - 1)), F.lit(0)).cast("int")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, at.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    groups = counts.groupBy(*by).agg(F.collect_list(F.struct("_b", "_n")).alias("_c"), F.sum("_n").alias("_all"))
    rows = groups.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    kernel = lambda c: c["_n"] * F.exp(-0.5 * F.pow((F.col("bin") - c["_b"]) * width / h, 2))
    total = F.aggregate("_c", F.lit(0.0), lambda a, c: a + kernel(c))
    own = F.aggregate("_c", F.lit(0).cast("long"), lambda a, c: a + F.when(c["_b"] == F.col("bin"), c["_n"]).otherwise(0))
    x = low + (F.col("bin") + 0.5) * width
    return rows.select(*by, "bin", x.alias("x"), own.alias("n"), (total / (F.col("_all") * h * math.sqrt(2 * math.pi))).alias("density"))


def summary_parts(df: DataFrame, by: Sequence[str], value: str, size: int = 200) -> DataFrame:
    """by, n, mean, m2, least, most, sketch: mergeable summaries, to be kept by day or file and merged by :func:`merge_summaries`.

    ``m2`` is the sum of squares about the mean. The sketch is a KLL sketch, drawn at
    random: its error is a share of the ranks that shrinks with ``size`` and not with the rows
    (measured over 39 quantiles of 40,000 values at 200: 0.5 %, 0.4 % merged from nine parts).
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.kll_sketch_agg_double(v, F.lit(size)).alias("sketch"),
    )


def merge_summaries(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The summaries of coarser groups from those of finer ones: counts add, moments shift to the common mean, sketches merge."""
    total = parts.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("_s"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch").alias("sketch")
    ).withColumn("mean", F.col("_s") / F.col("n")).drop("_s")
    about = parts.select(*by, "n", F.col("mean").alias("_own"), "m2").join(total.select(*by, F.col("mean").alias("_mean")), list(by)) if by else parts.select("n", F.col("mean").alias("_own"), "m2").crossJoin(F.broadcast(total.select(F.col("mean").alias("_mean"))))
    gap = F.col("_own") - F.col("_mean")
    spread = about.groupBy(*by).agg(F.sum(F.col("m2") + F.col("n") * gap * gap).alias("m2"))
    joined = total.join(spread, list(by)) if by else total.crossJoin(spread)
    return joined.select(*by, "n", "mean", "m2", "least", "most", "sketch")


def read_summaries(summaries: DataFrame, by: Sequence[str], probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """by, n, mean, sd, q: as :func:`distribution_summary`, quantiles from the sketch."""
    q = F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for p in probs])
    return summaries.select(*by, "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("sd"), q.alias("q"))


def shannon_entropy(df: DataFrame, key: str, symbol: str) -> DataFrame:
    """key, entropy in bits of its symbols."""
    n = df.groupBy(key, symbol).agg(F.count(F.lit(1)).alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(key)))
    return p.groupBy(key).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def random_entropy(df: DataFrame, key: str, symbol: str) -> DataFrame:
    return df.groupBy(key).agg(F.log2(F.countDistinct(symbol)).alias("random_entropy"))


def predictability_bound(entropy: Column, n: Column, steps: int = 60) -> Column:
    """The upper root p of entropy = H(p) + (1 - p) log2(n - 1), by bisection on [1/n, 1] in each row; 1 where n < 2."""
    h = lambda p: -(F.when(p > 0, p * F.log2(p)).otherwise(0.0) + F.when(p < 1, (1 - p) * F.log2(1 - p)).otherwise(0.0))
    over = lambda p: h(p) + (1 - p) * F.log2(n - 1) > entropy
    start = F.struct((F.lit(1.0) / n).alias("lo"), F.lit(1.0).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        return F.struct(F.when(over(mid), mid).otherwise(acc["lo"]).alias("lo"), F.when(over(mid), acc["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda acc: (acc["lo"] + acc["hi"]) / 2)
    return F.when(n < 2, F.lit(1.0)).otherwise(found)


def states_per_user(df: DataFrame, key: str = "uid", state: str = "state") -> DataFrame:
    return df.groupBy(key).agg(F.countDistinct(state).alias("n_states"))


def cluster_membership_share(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    n = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(df.select(F.count(F.lit(1)).alias("_all")))).select(cluster, "n", (100.0 * F.col("n") / F.col("_all")).alias("percent"))


def hourly_forecast_profile(weather: DataFrame, value: str, shift: float = 0.0, ts: str = "ts") -> DataFrame:
    return weather.groupBy(F.hour(ts).alias("hour")).agg((F.avg(value) + F.lit(shift)).alias(value))


def mean_by_group_id(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.avg(c).alias(c) for c in cols])
