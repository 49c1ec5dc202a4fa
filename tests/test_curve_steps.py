"""The robust curve is put on a user's sums by numpy, equal rows go through its rounds once, and outer degrees hold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wattweave.plans import curves


def test_fits_are_not_interpreted_by_expressions(spark):
    df = spark.range(200).select(F.lit(1).alias("uid"), (F.col("id") % 20).cast("double").alias("t"), F.pow(F.col("id") % 20, 2).alias("y"))
    out = curves.robust_response_curve(df, "y", "t", -2, 25)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "MapInPandas" in plan and "filter(" not in plan
    rows = {r["grid"]: r for r in out.collect()}
    assert len(rows) == 28 and rows[-2]["fit"] == rows[0]["fit"] and rows[25]["fit"] == rows[19]["fit"]
    assert abs(rows[7]["slope"] - (rows[7]["fit"] - rows[6]["fit"])) < 1e-12 and rows[25]["slope"] == rows[19]["slope"]


def test_blocks_of_points_give_one_curve():
    rng = np.random.default_rng(3)
    x, n = np.arange(40.0), rng.integers(1, 9, 40)
    w, wy = n * 1.0, n * rng.random(40)
    assert np.array_equal(curves._local_lines(x, n, w, wy, 90), curves._local_lines(x, n, w, wy, 90, block=7))
