"""Boosted trees learn from rows that are alike as one row, and no fit is made twice."""

from __future__ import annotations

import numpy as np
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from wattweave.operators import clean


def test_one_fit_on_distinct_inputs(spark, monkeypatch):
    rng = np.random.default_rng(31)
    rows = [(i, i % 7, float(i % 5), None if i % 11 == 0 else float((i % 7) * 3 + i % 5 + rng.normal(0, 0.1))) for i in range(1000)]
    df = spark.createDataFrame(rows, "id int, hour int, temperature double, obs double").repartition(3)
    seen, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, data, *a: seen.append(data.count()) or fit(self, data, *a))
    got = {r["id"]: r["obs"] for r in clean.impute_regression(df, ["obs", "temperature"], ["hour"]).collect()}
    assert seen == [35]
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=["temperature", "hour"], outputCol="x").transform(df)
    model = GBTRegressor(featuresCol="x", labelCol="obs", predictionCol="p", maxIter=20, maxDepth=3, stepSize=0.1, seed=1)
    want = {r["id"]: r["p"] for r in fit(model, data.where("obs IS NOT NULL")).transform(data.where("obs IS NULL")).select("id", "p").collect()}
    assert len(want) == 91 and max(abs(got[i] - p) for i, p in want.items()) < 1e-9
    assert all(got[r[0]] == r[3] for r in rows if r[3] is not None)


def test_inputs_with_gaps_are_fitted_in_each_round(spark, monkeypatch):
    df = spark.range(60).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 5).alias("a"), F.when(F.col("id") % 6 > 0, F.col("id") % 5 * 2).alias("b"))
    seen, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, data, *a: seen.append(1) or fit(self, data, *a))
    out = clean.impute_regression(df, ["a", "b"], rounds=2, trees=2)
    assert len(seen) == 4 and out.where("a IS NULL OR b IS NULL").count() == 0 and out.count() == 60
