"""Clustering without rows multiplied by centres: sweeps against single runs, plans, stops."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wattweave.plans import segments


def points(spark, n=120, seed=4):
    rng = np.random.default_rng(seed)
    middle = np.array([[0, 0, 0], [8, 0, 4], [0, 9, -5]])
    rows = [(i, (middle[i % 3] + rng.normal(0, 1, 3)).tolist(), rng.uniform(0.5, 2, 3).tolist()) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, [1.0] * 3), (n + 1, [1.0] * 3, None)], "id int, v array<double>, s array<double>").repartition(3)


def test_error_aware_sweep(spark):
    df = points(spark)
    told = {r["k"]: r["objective"] for r in segments.kerror_sweep(df, [1, 2, 3, 6]).collect()}
    assert told[3] < 0.3 * told[2] < told[1] and told[6] < told[3]
    members, _ = segments.kerror_cluster(df, 3)
    assert abs(members.agg(F.sum("distance")).first()[0] / told[3] - 1) < 0.02
    x = np.array([r["v"] for r in df.where("v IS NOT NULL AND s IS NOT NULL").collect()])
    s = np.array([r["s"] for r in df.where("v IS NOT NULL AND s IS NOT NULL").collect()])
    mean = (x / s).sum(axis=0) / (1 / s).sum(axis=0)
    assert abs(told[1] / ((x - mean) ** 2 / s).sum() - 1) < 1e-9
    change = {r["k"]: r["change"] for r in segments.elbow_table(segments.kerror_sweep(df, [2, 3, 4]), "objective").collect()}
    assert change[2] is None and change[3] > 0.6 > 0.3 > change[4]
    assert segments.kerror_sweep(df.where("false"), [2, 3]).count() == 0


def test_no_row_for_each_centre_is_shuffled(spark):
    df = points(spark)
    members, centres = segments.kerror_cluster(df, 3)
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and members.count() == 120
    soft, mu = segments.fuzzy_cmeans(df.where("s IS NOT NULL"), 3)
    assert "Exchange hashpartitioning" not in soft._jdf.queryExecution().executedPlan().toString()
    best = soft.groupBy("id").agg(F.max_by("cluster", "membership").alias("c"), F.sum("membership").alias("t")).collect()
    assert all(abs(r["t"] - 1) < 1e-9 for r in best) and len({(r["id"] % 3, r["c"]) for r in best}) == 3
    assert {tuple(round(v / 3) for v in r["mu"]) for r in mu.collect()} == {(0, 0, 0), (3, 0, 1), (0, 3, -2)}
    assert segments.fuzzy_cmeans(df.where("false"), 3)[0].count() == 0
