"""Clustering of households: k-means, fuzzy c-means, clustering with measurement error, segment profiles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattweave.functions.vectors import square_distance, vector_sum
from wattweave.spread import small
from wattweave.storage import cut_lineage

CENTRES = "cluster int, mu array<double>, se array<double>"


def kmeans_sweep(df: DataFrame, ks: Sequence[int], vector: str = "v", seed: int = 1, iterations: int = 20) -> DataFrame:
    """k, within_ss, explained of k-means for each k; the total is that about the mean."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector)).alias("_v")).persist()
    fit = lambda k: KMeans(featuresCol="_v", k=k, seed=seed, maxIter=iterations).fit(data).summary.trainingCost
    dims = df.select(F.posexplode(vector).alias("d", "x")).groupBy("d").agg((F.var_pop("x") * F.count("x")).alias("s"))
    total = dims.agg(F.sum("s")).first()[0] or 0.0
    rows = [(k, float(w), 1 - float(w) / total if total else None) for k in ks for w in [fit(k) if k > 1 else total]]
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, within_ss double, explained double")


def kmeans_labels(df: DataFrame, k: int, key: str = "id", vector: str = "v", seed: int = 1, iterations: int = 20) -> tuple[DataFrame, DataFrame]:
    """(id, cluster) of every row with a vector, and (cluster, mu, n): labels and centres of one k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector)).alias("_v"))
    model = KMeans(featuresCol="_v", predictionCol="cluster", k=k, seed=seed, maxIter=iterations).fit(data)
    labels = model.transform(data).select(key, "cluster")
    centres = [(i, list(map(float, c))) for i, c in enumerate(model.clusterCenters())]
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return labels, df.sparkSession.createDataFrame(centres, "cluster int, mu array<double>").join(sizes, "cluster", "left")


def elbow_table(costs: DataFrame, cost: str = "within_ss") -> DataFrame:
    """Adds ``change``: the relative fall from the k before. The table has a row for each k."""
    before = F.lag(cost).over(Window.partitionBy(F.lit(0)).orderBy("k"))
    return costs.withColumn("change", F.when(before > 0, (before - F.col(cost)) / before))


def _start(df: DataFrame, k: int, key: str, vector: str) -> list[list[float]]:
    """The first k rows in the order of a hash of their keys (a top-k, not a sort)."""
    rows = df.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(key).cast("string")), key).select(vector).limit(k).collect()
    return [list(map(float, r[0])) for r in rows]


def _with_models(points: DataFrame, models: list[list[list[float]]]) -> DataFrame:
    """``points`` with ``_m``, the centres of each model in one array: one row is broadcast, and no row is multiplied."""
    return points.crossJoin(F.broadcast(points.sparkSession.createDataFrame([(models,)], "_m array<array<array<double>>>")))


def _nearest(model: Column, x: Column, scale: Column | None = None) -> Column:
    """struct<d, cluster> of the nearest centre, the first of equals."""
    return F.array_min(F.transform(model, lambda c, i: F.struct(square_distance(x, c, scale).alias("d"), i.cast("int").alias("cluster"))))


def fuzzy_cmeans(df: DataFrame, k: int, m: float = 2.0, iterations: int = 100, key: str = "id", vector: str = "v", tol: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, membership) and (cluster, mu): soft memberships and centres.

    Ends when no centre moves by more than ``tol`` of the spread that they began with, or
    after ``iterations`` rounds. A round is one aggregation; k centres are broadcast.
    """
    spark = df.sparkSession
    points = cut_lineage(df.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("x")))
    centres = _start(points, k, key, "x")
    spread = max(float(np.ptp(np.array(centres), axis=0).max()), 1e-12) if centres else 0.0

    def memberships() -> DataFrame:
        inverse = F.transform(F.get("_m", F.lit(0)), lambda c: F.pow(F.greatest(square_distance(F.col("x"), c), F.lit(1e-12)), F.lit(-1.0 / (m - 1))))
        shared = _with_models(points, [centres]).withColumn("_i", inverse).withColumn("_t", vector_sum(F.col("_i")))
        return shared.select(key, "x", F.posexplode(F.transform("_i", lambda i: i / F.col("_t"))).alias("cluster", "membership"))

    for _ in range(iterations):
        u = F.pow("membership", F.lit(m))
        sums = memberships().select("cluster", u.alias("u"), F.posexplode("x").alias("dim", "v")).groupBy("cluster", "dim").agg((F.sum(F.col("u") * F.col("v")) / F.sum("u")).alias("mu"))
        moved: dict[int, dict[int, float]] = {}
        for r in sums.collect():  # k x dimensions numbers
            moved.setdefault(r["cluster"], {})[r["dim"]] = r["mu"]
        now = [[moved[i][d] for d in sorted(moved[i])] for i in sorted(moved)]
        still = bool(now) and float(np.abs(np.array(now) - np.array(centres)).max()) <= tol * spread
        centres = now
        if still or not now:
            break
    out = memberships().select(key, "cluster", "membership") if centres else points.select(key, F.lit(0).alias("cluster"), F.lit(1.0).alias("membership"))
    return out, spark.createDataFrame([(i, c) for i, c in enumerate(centres)], "cluster int, mu array<double>")


def _assign(model: list, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id, cluster, distance, x, s of points with a full covariance (rows of it, one after the other): the least (x - c)' S^-1 (x - c)."""
    for batch in batches:
        if len(batch):
            x = np.stack(batch["x"].to_numpy()).astype(float)
            s = np.stack(batch["s"].to_numpy()).astype(float).reshape(len(x), x.shape[1], x.shape[1])
            gaps = x[:, None, :] - np.array(model)[None]
            d = np.einsum("nkp,npk->nk", gaps, np.linalg.solve(s, gaps.transpose(0, 2, 1)))
            best = d.argmin(axis=1)
            yield pd.DataFrame({batch.columns[0]: batch.iloc[:, 0], "cluster": best.astype("int32"), "distance": d[np.arange(len(x)), best], "x": batch["x"], "s": batch["s"]})


def _information(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """cluster, i, j, v: sums over a task of S^-1 (j from 0) and S^-1 x (j = -1) of the points of each cluster."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for cluster, own in batch.groupby("cluster"):
            x = np.stack(own["x"].to_numpy()).astype(float)
            p = x.shape[1]
            inverse = np.linalg.inv(np.stack(own["s"].to_numpy()).astype(float).reshape(-1, p, p))
            told = np.concatenate([np.einsum("npq,nq->p", inverse, x)[:, None], inverse.sum(axis=0)], axis=1)
            sums[int(cluster)] = sums.get(int(cluster), 0.0) + told
    for cluster, m in sums.items():
        i, j = np.indices(m.shape)
        yield pd.DataFrame({"cluster": cluster, "i": i.ravel(), "j": j.ravel() - 1, "v": m.ravel()})


def covariances(days: DataFrame, key: str = "uid", vector: str = "v") -> DataFrame:
    """uid, w: the population covariance between the places of a user's vectors, its rows one after the other; a user's days are one row on the way."""
    kind = dict(days.dtypes)[key]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gaps = [x - x.mean(axis=0) for x in (np.stack(v).astype(float) for v in pdf["_v"])]
            yield pd.DataFrame({key: pdf[key], "w": [(x.T @ x / len(x)).ravel() for x in gaps]})

    return days.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(vector).alias("_v")).mapInPandas(work, f"{key} {kind}, w array<double>")


def kerror_cluster(
    df: DataFrame, k: int, iterations: int = 20, key: str = "id", vector: str = "v", error: str = "s", full: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, distance) and (cluster, mu, se): k-means where each point has its own measurement error.

    ``error`` holds a variance for each dimension, or with ``full`` the rows of a
    covariance matrix one after the other. Points go to the centre at the least
    error-scaled squared distance; centres are inverse-covariance weighted
    means, with standard errors. Stops when under 1 % of points move or the
    objective falls by under 0.5 %. A centre that loses its points stays where it
    was. Of the points only sums for each cluster reach the driver.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[key]
    floor = (lambda e: e.cast("double")) if full else (lambda e: F.greatest(e.cast("double"), F.lit(1e-12)))
    points = cut_lineage(
        df.where(F.col(vector).isNotNull() & F.col(error).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("x"), F.transform(error, floor).alias("s"))
    )
    centres = _start(points, k, key, "x")
    errors = [[0.0] * len(c) for c in centres]

    def assigned() -> DataFrame:
        if full:
            model = [c[:] for c in centres]
            told = [key, "cluster", "distance"]
            return points.mapInPandas(lambda batches: (b[told] for b in _assign(model, batches)), f"{key} {kind}, cluster int, distance double")
        best = _with_models(points, [centres]).withColumn("_b", _nearest(F.get("_m", F.lit(0)), F.col("x"), F.col("s")))
        return best.select(key, F.col("_b.cluster").alias("cluster"), F.col("_b.d").alias("distance"), "x", "s")

    def move(rows: DataFrame) -> None:
        if full:
            model = [c[:] for c in centres]
            sums = points.mapInPandas(lambda batches: _information(_assign(model, batches)), "cluster int, i int, j int, v double").groupBy("cluster", "i", "j").agg(F.sum("v").alias("v")).collect()
            for c in {r["cluster"] for r in sums}:
                own = {(r["i"], r["j"]): r["v"] for r in sums if r["cluster"] == c}
                p = len(centres[c])
                inverse = np.linalg.inv([[own[i, j] for j in range(p)] for i in range(p)])
                centres[c] = (inverse @ [own[i, -1] for i in range(p)]).tolist()
                errors[c] = np.sqrt(np.diag(inverse)).tolist()
            return
        each = rows.select("cluster", F.posexplode(F.arrays_zip("x", "s")).alias("dim", "p")).groupBy("cluster", "dim")
        for r in each.agg(F.sum(F.col("p.x") / F.col("p.s")).alias("a"), F.sum(1 / F.col("p.s")).alias("b")).collect():
            centres[r["cluster"]][r["dim"]] = r["a"] / r["b"]
            errors[r["cluster"]][r["dim"]] = (1 / r["b"]) ** 0.5

    objective, before = None, None
    for _ in range(iterations):
        rows = assigned()
        now = cut_lineage(rows.select(key, "cluster", "distance"))  # points and errors were stored once and are read again
        move(rows)
        total = now.agg(F.sum("distance"), F.count(F.lit(1))).first()
        moved = total[1] if before is None else now.join(before.select(key, F.col("cluster").alias("_was")), key).where("cluster <> _was").count()
        fall = None if objective is None or not objective else (objective - (total[0] or 0.0)) / objective
        before, objective = now, total[0]
        if not total[1] or moved <= 0.01 * total[1] or (fall is not None and 0 <= fall < 0.005):
            break
    return assigned().select(key, "cluster", "distance"), spark.createDataFrame([(i, c, e) for i, (c, e) in enumerate(zip(centres, errors, strict=True))], CENTRES)


def _sweep_sums(models: list, batches: Iterator[pd.DataFrame], rows: int = 128) -> Iterator[pd.DataFrame]:
    """size, cluster, dim, a, w, d: sums over a task of x / s, 1 / s and, at dim 0, the distances to the nearest centre of each model; ``rows`` points at a time."""
    centres = [np.array(m) for m in models]
    sums = [np.zeros((*c.shape, 3)) for c in centres]
    for batch in batches:
        if not len(batch):
            continue
        x, s = (np.stack(batch[c].to_numpy()).astype(float) for c in ("x", "s"))
        gone = np.isnan(x) | np.isnan(s)
        weight, x = np.where(gone, 0.0, 1 / np.where(gone, 1.0, s)), np.where(gone, 0.0, x)
        for at in range(0, len(x), rows):
            own, w = x[at : at + rows], weight[at : at + rows]
            for c, told in zip(centres, sums, strict=True):
                gaps = own[:, None, :] - c
                d = np.einsum("nkp,nkp,np->nk", gaps, gaps, w)
                best = d.argmin(axis=1)
                mine = (best == np.arange(len(c))[:, None]).astype(float)
                told[:, :, 0] += mine @ (own * w)
                told[:, :, 1] += mine @ w
                told[:, 0, 2] += mine @ d[np.arange(len(own)), best]
    for size, told in enumerate(sums):
        cluster, dim = np.nonzero(told[:, :, 1] > 0)
        yield pd.DataFrame({"size": size, "cluster": cluster, "dim": dim, "a": told[cluster, dim, 0], "w": told[cluster, dim, 1], "d": told[cluster, dim, 2]})


def kerror_sweep(df: DataFrame, ks: Sequence[int], iterations: int = 20, key: str = "id", vector: str = "v", error: str = "s") -> DataFrame:
    """k, objective: the least error-scaled objective of each size, for :func:`elbow_table`.

    All sizes advance together, a job for each round; a size stops when its objective falls by under
    0.5 %. Starts are nested: a larger size begins with the points of a smaller one, and more.
    Points meet the centres in numpy and a task tells its sums alone; elements that are null or NaN count nowhere.
    """
    spark = df.sparkSession
    scale = F.transform(error, lambda e: F.greatest(e.cast("double"), F.lit(1e-12)))
    points = cut_lineage(df.where(F.col(vector).isNotNull() & F.col(error).isNotNull()).select(F.col(vector).cast("array<double>").alias("x"), scale.alias("s"), F.col(key).alias("_key")))
    first = _start(points, max(ks, default=0), "_key", "x")
    models, objective = {k: [list(c) for c in first[:k]] for k in ks if first}, {}
    open_ = list(models)
    for _ in range(iterations):
        if not open_:
            break
        told = [models[k] for k in open_]
        each = points.select("x", "s").mapInPandas(lambda batches, told=told: _sweep_sums(told, batches), "size int, cluster int, dim int, a double, w double, d double")
        sums = each.groupBy("size", "cluster", "dim").agg(*[F.sum(c).alias(c) for c in ("a", "w", "d")]).collect()
        total = dict.fromkeys(open_, 0.0)
        for r in sums:  # sizes x centres x dimensions
            if r["w"]:
                models[open_[r["size"]]][r["cluster"]][r["dim"]] = r["a"] / r["w"]
            total[open_[r["size"]]] += r["d"]
        for k in list(open_):
            before = objective.get(k)
            objective[k] = min(total[k], before if before is not None else total[k])
            if before is not None and before - total[k] < 0.005 * before:
                open_.remove(k)
    return spark.createDataFrame([(k, objective[k]) for k in ks if k in objective], "k int, objective double")


def segment_profile(centres: DataFrame, members: DataFrame) -> DataFrame:
    """cluster, hour, mu, low, high, percent: centre and one standard error about it, with the share of members."""
    n = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    share = n.crossJoin(F.broadcast(members.select(F.count(F.lit(1)).alias("_all")))).select("cluster", (100.0 * F.col("n") / F.col("_all")).alias("percent"))
    hours = centres.select("cluster", F.posexplode(F.arrays_zip("mu", "se")).alias("hour", "p"))
    return hours.select("cluster", "hour", "p.mu", (F.col("p.mu") - F.col("p.se")).alias("low"), (F.col("p.mu") + F.col("p.se")).alias("high")).join(share, "cluster")


def pairwise_distance(x: DataFrame, centres: DataFrame, key: str = "id", vector: str = "v", error: str = "s") -> DataFrame:
    """id, cluster, distance: the error-scaled squared distance of every point to every (broadcast) centre."""
    d = square_distance(F.col(vector), F.col("mu"), F.col(error))
    return x.crossJoin(small(centres.select("cluster", "mu"))).select(key, "cluster", d.alias("distance"))
