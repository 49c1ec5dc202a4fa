"""Cleaning: out-of-range and extreme values, sparse columns, duplicates, gaps, imputation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattweave.functions.calendar import season
from wattweave.spread import ordered_rank, spare
from wattweave.storage import cut_lineage

# Plausible ranges of weather covariates, by rule set.
RANGES = {
    "align": {"temperature": (2, 125), "pressure": (27, 33), "humidity": (1, 100), "precip": (0, None), "wind": (0, 70), "dewpoint": (0, 125)},
    "narrow": {"temperature": (2, 125), "pressure": (25, 35), "humidity": (5, 100)},
    "common": {"temperature": (0, 125), "pressure": (25, 35), "humidity": (5, 100), "dewpoint": (0, 125)},
}


def null_out_of_range(df: DataFrame, rules: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values outside [low, high] become null; a bound of None is open."""
    out = {}
    for name, (low, high) in rules.items():
        ok = F.lit(True)
        if low is not None:
            ok = ok & (F.col(name) >= low)
        if high is not None:
            ok = ok & (F.col(name) <= high)
        out[name] = F.when(ok, F.col(name))
    return df.withColumns(out)


def trim_quantiles(df: DataFrame, cols: Sequence[str], by: str, lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    """Values outside a key's exact (interpolated) quantiles become null."""
    q = dict(zip(cols, spare(df, *cols), strict=True))
    bounds = df.groupBy(by).agg(*[F.percentile(c, F.array(F.lit(lo), F.lit(hi))).alias(q[c]) for c in cols])
    joined = df.join(bounds, by)
    return joined.withColumns({c: F.when(F.col(c).between(F.col(q[c])[0], F.col(q[c])[1]), F.col(c)) for c in cols}).drop(*q.values())


def cap_to_null(df: DataFrame, cols: Sequence[str], cap: float = 100.0) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) <= cap, F.col(c)) for c in cols})


def drop_empty_columns(long: DataFrame, min_cols: int = 4, key: str = "uid", circuit: str = "circuit", value: str = "kw") -> DataFrame:
    """Circuits that are null or 0 throughout go; keys left with fewer than ``min_cols`` circuits go whole."""
    used = long.groupBy(key, circuit).agg(F.max(F.abs(value)).alias("_top")).where("_top > 0")
    rich = used.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_cols)
    return long.join(used.join(rich, key, "left_semi").select(key, circuit), [key, circuit], "left_semi")


def null_shares(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]).first()
    return {c: 1.0 if row[c] is None else row[c] for c in cols}


def drop_sparse_columns(df: DataFrame, max_null_share: float = 0.5, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns with a share of nulls above the limit go; an empty table keeps none of ``cols``."""
    shares = null_shares(df, cols or df.columns)
    return df.drop(*[c for c, share in shares.items() if share > max_null_share])


def drop_constant_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numeric columns whose standard deviation is 0 or undefined go."""
    row = df.agg(*[F.stddev_samp(c).alias(c) for c in cols]).first()
    return df.drop(*[c for c in cols if not row[c] or row[c] != row[c]])


def drop_all_null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(how="all", subset=list(cols))


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(how="any", subset=list(cols))


def dedupe_timestamps(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row, by ``order``, of each key: an aggregation, so that a frequent key folds within each task."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return first.select(*keys, "_row.*").select(*df.columns)


def min_history(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows of keys that have ``n`` rows or more."""
    return df.join(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(key), key, "left_semi")


def require_hvac(df: DataFrame, categories: Sequence[str] = ("C", "H"), key: str = "uid", category: str = "category", total: str = "total") -> DataFrame:
    """Rows of keys that hold some of the categories, and a total."""
    has = df.groupBy(key).agg(
        F.max(F.col(category).isin(*categories).cast("int")).alias("_hvac"), F.max((F.col(category) == total).cast("int")).alias("_total")
    )
    return df.join(has.where("_hvac = 1 AND _total = 1").select(key), key, "left_semi")


def reject_degenerate(df: DataFrame, key: str, value: str) -> DataFrame:
    """Series that are null throughout or never change go."""
    return df.join(df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).where("_hi > _lo").select(key), key, "left_semi")


def select_data(
    df: DataFrame, include_weekends: bool = True, include_weekdays: bool = True, seasons: Sequence[str] = ("Summer", "Winter"),
    summer_months: Sequence[int] | str = "apr_oct", ts: str = "ts",
) -> DataFrame:
    weekend = F.dayofweek(ts).isin(1, 7)
    keep = season(F.col(ts), summer_months).isin(*seasons)
    if not include_weekends:
        keep = keep & ~weekend
    if not include_weekdays:
        keep = keep & weekend
    return df.where(keep)


def rename_covariates(df: DataFrame, mapping: Mapping[str, str], keys: Sequence[str] = ("ts",)) -> DataFrame:
    """The keys, and the covariates of the mapping under their new names."""
    return df.select(*keys, *[F.col(a).alias(b) for a, b in mapping.items()])


def _bends(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of the cubic splines through them, zero at both ends: elimination, then back substitution.

    A row is a spline, of which the first ``n`` knots count.
    """
    m, upper, right = (np.zeros(x.shape) for _ in range(3))
    h = np.where(np.arange(x.shape[1] - 1) < n[:, None] - 1, np.diff(x, axis=1), 1.0)
    slope = np.diff(y, axis=1) / h
    for i in range(1, x.shape[1] - 1):
        pivot = 2 * (h[:, i - 1] + h[:, i]) - h[:, i - 1] * upper[:, i - 1]
        inner = i < n - 1
        upper[:, i] = np.where(inner, h[:, i] / pivot, 0.0)
        right[:, i] = np.where(inner, (6 * (slope[:, i] - slope[:, i - 1]) - h[:, i - 1] * right[:, i - 1]) / pivot, 0.0)
    for i in range(x.shape[1] - 2, 0, -1):
        m[:, i] = right[:, i] - upper[:, i] * m[:, i + 1]
    return m


def _placed_bends(placed: DataFrame, block: int = 512, margin: int = 64, splines: int = 256) -> DataFrame:
    """key, x, bend and that of the next knot, from knots (key, x, y) with their place ``n`` in their series; a block is one row, ``splines`` of them are solved at a time."""
    at = lambda shift: F.greatest(F.floor((F.col("n") + shift) / block), F.lit(0))
    spread = placed.withColumn("block", F.explode(F.sequence(at(-margin), at(margin))))
    blocks = spread.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y"))).alias("k"))
    rows = blocks.select("key", "block", *[F.col(f"k.{c}").alias(c) for c in ("n", "x", "y")])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), splines):
                some = batch.iloc[start : start + splines]
                size = some["x"].map(len).to_numpy()
                inside = np.arange(size.max() + 1) < size[:, None]
                n, x, y = (np.zeros(inside.shape) for _ in range(3))
                for c, told in (("n", n), ("x", x), ("y", y)):
                    told[inside] = np.concatenate(some[c].to_numpy())
                m = _bends(x, y, size)
                row, place = np.nonzero(inside & (n // block == some["block"].to_numpy()[:, None]))
                yield pd.DataFrame({"key": some["key"].to_numpy()[row], "x": x[row, place], "bend": m[row, place], "after": m[row, place + 1]})

    return rows.mapInPandas(solve, f"key {dict(placed.dtypes)['key']}, x double, bend double, after double")


def spline_bends(knots: DataFrame, key: str, x: str, y: str, block: int = 512, margin: int = 64) -> DataFrame:
    """key, x, bend: the second derivatives of each series' natural cubic spline at its knots, a series of any length in blocks.

    What a knot does to the bend of another falls by half or more with each knot between, so a block
    solved with ``margin`` knots on either side has its own to double precision.
    """
    placed = ordered_rank(knots.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")), [F.col("x")], "n", by=["key"])
    return _placed_bends(placed, block, margin).select("key", "x", "bend")


def gap_fill(df: DataFrame, value: str, max_gap: int = 12, key: str = "uid", ts: str = "ts", method: str = "line") -> DataFrame:
    """Values in gaps of up to ``max_gap`` rows between known ones, on a ``line`` or a cubic ``spline``; then rows still null go.

    Rows are taken as evenly spaced. The known values before and after a row come from one order of
    a key's rows. Longer gaps, and gaps at either end, stay null. The spline runs through all known
    values of a series and is straight at its ends; rows that stay are stored once, and those of gaps meet the bends of the knot before them.
    """
    if method not in ("line", "spline"):
        raise ValueError(f"no method {method}")
    i, n, a, b, bend, after, known, at, va, vb, width, share = spare(df, "i", "n", "a", "b", "bend", "after", "known", "at", "va", "vb", "width", "share")
    w = Window.partitionBy(key).orderBy(ts)
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col(value).isNotNull(), F.struct(F.col(i).alias("i"), F.col(value).alias("v")))
    quoted = [f"`{c.replace('`', '``')}`" for c in (known, key, ts)]
    spanned = df.withColumns({i: F.row_number().over(w), n: F.count(value).over(sofar)}).withColumn(known, own)
    spanned = spanned.withColumns({a: F.last(known, ignorenulls=True).over(sofar), b: F.expr("lead({}) IGNORE NULLS OVER (PARTITION BY {} ORDER BY {})".format(*quoted))})
    gap, left, right = F.col(value).isNull(), F.col(a), F.col(b)
    stay = spanned.where(~gap | (right["i"] - left["i"] - 1 <= max_gap))
    told = {at: left["i"], va: left["v"], vb: right["v"], width: right["i"] - left["i"]}
    stay = stay.select(*df.columns, i, n, *[F.when(gap, e).alias(c) for c, e in told.items()]).withColumn(share, (F.col(i) - F.col(at)) / F.col(width))
    between = F.col(va) + (F.col(vb) - F.col(va)) * (F.col(i) - F.col(at)) / F.col(width)
    if method == "spline":
        stay = cut_lineage(stay)
        knots = stay.where(~gap & F.col(key).isNotNull())
        bends = _placed_bends(knots.select(F.col(key).alias("key"), F.col(i).cast("double").alias("x"), F.col(value).cast("double").alias("y"), F.col(n).alias("n")))
        told = bends.select(F.col("key").alias(key), F.col("x").cast("int").alias(at), F.col("bend").alias(bend), F.col("after").alias(after))
        stay = stay.join(told, [key, at], "left")
        s, r = F.col(share), 1 - F.col(share)
        between = between + ((r * r * r - r) * F.coalesce(bend, F.lit(0.0)) + (s * s * s - s) * F.coalesce(after, F.lit(0.0))) * F.col(width) * F.col(width) / 6
    return stay.withColumn(value, F.coalesce(F.col(value), between)).select(*df.columns)


def interpolate_to_grid(df: DataFrame, cols: Sequence[str], step_seconds: int, key: str = "station", ts: str = "ts") -> DataFrame:
    """Values on a regular grid from a key's first to its last time: linear between observations, constant beyond the ends of a column.

    The grid starts at the first time rounded down to the step.
    """
    sec = df.select(key, F.unix_timestamp(ts).alias("_s"), *cols)
    span = sec.groupBy(key).agg(
        (F.floor(F.min("_s") / step_seconds) * step_seconds).alias("a"), (F.floor(F.max("_s") / step_seconds) * step_seconds).alias("b")
    )
    grid = span.select(key, F.explode(F.sequence("a", "b", F.lit(step_seconds).cast("long"))).alias("_s")).withColumn("_g", F.lit(True))
    both = grid.unionByName(sec.withColumn("_g", F.lit(False)), allowMissingColumns=True)
    back = Window.partitionBy(key).orderBy("_s", "_g").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.col("_s").desc(), F.col("_g").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("_s").alias("s"), F.col(c).cast("double").alias("v")))
        a, b = F.last(known, ignorenulls=True).over(back), F.last(known, ignorenulls=True).over(ahead)
        line = a["v"] + (b["v"] - a["v"]) * (F.col("_s") - a["s"]) / F.greatest(b["s"] - a["s"], F.lit(1))
        out[c] = F.coalesce(line, a["v"], b["v"])
    return both.withColumns(out).where("_g").select(key, F.timestamp_seconds("_s").alias(ts), *cols)


def impute_regression(
    df: DataFrame, cols: Sequence[str], predictors: Sequence[str] = (), rounds: int = 2, trees: int = 20, depth: int = 3, step: float = 0.1,
    method: str = "boosted",
) -> DataFrame:
    """Nulls of ``cols`` filled by boosted trees on the other columns and ``predictors``; ``method="none"`` leaves them.

    Nulls start at the column's mean; each round fits every column on the rows
    where it was observed and predicts the rest. (No random multivariate draw.)
    Rows with equal inputs are one to a fit, with their number as its weight and their mean as its label: for
    squared errors the same trees, on a table that grows with the distinct inputs. A column whose
    inputs have no gaps is fitted once, as a further round would give the same model.
    ``method="regression"`` is :func:`impute_linear`, whose rounds cost nothing.
    """
    if method == "none":
        return df
    if method == "regression":
        return impute_linear(df, cols, predictors)
    if method != "boosted":
        raise ValueError(f"no method {method}")
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    told = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.avg(F.col(c).isNull().cast("double")).alias(f"g{i}") for i, c in enumerate(cols)]).first()
    means, gaps = ({c: told[f"{kind}{i}"] for i, c in enumerate(cols)} for kind in "mg")
    filled = df.withColumns({f"_gap_{c}": F.col(c).isNull() for c in cols}).withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in cols}
    )
    for turn in range(rounds):
        for c in cols:
            if means[c] is None or not gaps[c]:  # nothing to learn from, or nothing to fill
                continue
            inputs = [x for x in [*cols, *predictors] if x != c and means.get(x, 0) is not None]
            if turn and not any(gaps.get(x) for x in inputs):  # nothing that the first fit learnt from has moved
                continue
            assembler = VectorAssembler(inputCols=inputs, outputCol="_x")
            alike = cut_lineage(filled.where(~F.col(f"_gap_{c}")).groupBy(*inputs).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.avg(c).alias("_y")))
            model = GBTRegressor(featuresCol="_x", labelCol="_y", weightCol="_n", predictionCol="_p", maxIter=trees, maxDepth=depth, stepSize=step, seed=1).fit(assembler.transform(alike))
            filled = model.transform(assembler.transform(filled)).withColumn(c, F.when(F.col(f"_gap_{c}"), F.col("_p")).otherwise(F.col(c))).drop("_x", "_p")
    return filled.select(*df.columns)


def sweep(a: np.ndarray, pivots: Sequence[int]) -> np.ndarray:
    """The symmetric matrix swept on ``pivots``; one that is collinear with those before it is passed over, as if it weren't there."""
    m, scale = a.astype(float).copy(), np.diagonal(a).copy()
    done = []
    for k in pivots:
        if m[k, k] <= 1e-10 * max(scale[k], 1e-300):
            continue
        pivot = m[k, k]
        row = m[k] / pivot
        m = m - np.outer(m[:, k], row)
        inverse = 1 / pivot
        m[k], m[:, k] = row, row
        m[k, k] = -inverse
        done.append(k)
    skipped = [k for k in pivots if k not in done]
    m[skipped, :] = 0.0
    m[:, skipped] = 0.0
    return m


def impute_linear(df: DataFrame, cols: Sequence[str], predictors: Sequence[str] = (), rounds: int = 100, tol: float = 1e-9, most_patterns: int = 4096) -> DataFrame:
    """Nulls (and NaNs) of ``cols`` filled by chained least squares on the other columns and ``predictors``.

    Nulls start at the column's mean; a round fits each column, in order, on the rows where it was
    observed and predicts the rest from what is filled so far; it ends when no coefficient moves by
    more than ``tol`` of its size, or after ``rounds``. A filled value is linear in what its row has, so all rounds
    work on the cross products of the columns, summed once for each pattern of gaps, and the
    rows are read twice whatever the rounds: for means and cross products. Patterns beyond
    ``most_patterns`` are an error. Columns without any value stay as they are;
    predictors may have gaps too, and keep them.
    """
    names = [*cols, *(p for p in predictors if p not in cols)]
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in names}
    means = df.agg(*[F.avg(number[c]).alias(f"m{i}") for i, c in enumerate(names)]).first()
    names = [c for i, c in enumerate(names) if means[f"m{i}"] is not None]
    means = [means[f"m{i}"] for i, c in enumerate([*cols, *(p for p in predictors if p not in cols)]) if c in names]
    n = len(names)
    if not n:
        return df
    x = [F.coalesce(number[c] - F.lit(m), F.lit(0.0)) for c, m in zip(names, means, strict=True)]
    gaps = F.concat(*[F.when(number[c].isNull(), "1").otherwise("0") for c in names])
    (pattern,) = (c + "_" * (1 + max(map(len, df.columns))) for c in ("pattern",))
    sums = [F.count(F.lit(1)).alias("n")] + [F.sum(x[i]).alias(f"s{i}") for i in range(n)] + [F.sum(x[i] * x[j]).alias(f"p{i} {j}") for i in range(n) for j in range(i + 1)]
    told = df.groupBy(gaps.alias("gaps")).agg(*sums).limit(most_patterns + 1).collect()
    if len(told) > most_patterns:
        raise ValueError(f"more than {most_patterns} patterns of gaps")
    gram, fill = {}, {}
    for r in told:
        g = np.zeros((n + 1, n + 1))  # the first is the constant
        g[0, 0] = r["n"]
        for i in range(n):
            g[0, i + 1] = g[i + 1, 0] = r[f"s{i}"]
            for j in range(i + 1):
                g[i + 1, j + 1] = g[j + 1, i + 1] = r[f"p{i} {j}"]
        gram[r["gaps"]] = g
        fill[r["gaps"]] = np.diag([1.0, *(float(b == "0") for b in r["gaps"])])  # rows: the filled columns in terms of what there is
    last: dict[int, np.ndarray] = {}
    for _ in range(rounds):
        moved = 0.0
        for c in range(1, n + 1):
            if all(p[c - 1] == "0" for p in gram) or all(p[c - 1] == "1" for p in gram):
                continue
            seen = sum(fill[p] @ gram[p] @ fill[p].T for p in gram if p[c - 1] == "0")
            others = [k for k in range(n + 1) if k != c]
            beta = sweep(seen, others)[c]
            beta[c] = 0.0
            scale = np.abs(beta).max() or 1.0
            moved = max(moved, float(np.abs(beta - last.get(c, 0.0)).max() / scale))
            last[c] = beta
            for p in gram:
                if p[c - 1] == "1":
                    fill[p][c] = beta @ fill[p]
        if moved <= tol:
            break
    table = [(p, [[float(v) for v in fill[p][names.index(c) + 1]] for c in cols if c in names]) for p in fill]
    known = F.broadcast(df.sparkSession.createDataFrame(table, f"{pattern} string, _lines array<array<double>>"))  # a row for each pattern
    joined = df.withColumn(pattern, gaps).join(known.withColumnRenamed("_lines", pattern + "b"), pattern)
    out = {}
    for at, c in enumerate([c for c in cols if c in names]):
        line = F.get(F.col(pattern + "b"), F.lit(at))
        value = sum((F.get(line, F.lit(k + 1)) * x[k] for k in range(n)), F.get(line, F.lit(0))) + F.lit(means[names.index(c)])
        out[c] = F.when(number[c].isNull(), value).otherwise(F.col(c).cast("double"))
    return joined.withColumns(out).select(*df.columns)


def missingness_report(df: DataFrame, key: str, cols: Sequence[str], ts: str = "ts") -> DataFrame:
    """first_ts, last_ts, n_rows, nulls_<col> and the share of null points of each key."""
    nulls = [F.sum(F.col(c).isNull().cast("long")).alias(f"nulls_{c}") for c in cols]
    out = df.groupBy(key).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n_rows"), *nulls)
    total = sum((F.col(f"nulls_{c}") for c in cols), F.lit(0))
    return out.withColumn("null_share", total / (F.col("n_rows") * len(cols)))


def before_after_distribution(before: DataFrame, after: DataFrame, cols: Sequence[str], low: float, high: float, bins: int) -> DataFrame:
    """Counts by covariate, bucket (0 below ``low``, bins + 1 from ``high`` on) and stage (original, cleaned)."""

    def tall(df: DataFrame, stage: str) -> DataFrame:
        return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "covariate", "value").withColumn("stage", F.lit(stage))

    both = tall(before, "original").unionByName(tall(after, "cleaned")).where("value IS NOT NULL")
    return both.groupBy("covariate", "stage", F.width_bucket("value", F.lit(low), F.lit(high), F.lit(bins)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def clip_negative_rates(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.when(F.col(col).isNotNull(), F.greatest(F.col(col), F.lit(0.0))))


def is_complete(cols: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    return ok
