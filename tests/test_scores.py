"""Likelihoods without the shares of rows, and responses of decoded rows without a shuffle by row."""

from __future__ import annotations

import datetime as dt

import numpy as np
from test_passes import FITS, model

from wattweave.plans import interpret, regimes


def test_likelihoods_are_those_of_the_full_pass(spark):
    rng, start = np.random.default_rng(3), dt.datetime(2024, 1, 1)
    fits = spark.createDataFrame([f for u, k in (("a", 2), ("b", 3)) for f in model(u, k, rng)], FITS)
    rows = [(u, start + dt.timedelta(hours=i), float(rng.normal(6, 3)), float(rng.normal(0, 10))) for u in "ab" for i in range(300)]
    df = spark.createDataFrame(rows, "uid string, ts timestamp, obs double, t_d double")
    want = {r["uid"]: r["loglik"] for r in regimes.smooth_states(df, fits)[1].collect()}
    got = {r["uid"]: r["loglik"] for r in regimes.log_likelihoods(df, fits).collect()}
    assert set(got) == {"a", "b"} and all(abs(got[u] - want[u]) < 1e-8 * abs(want[u]) for u in want)


def test_responses_stay_in_their_row(spark):
    at = dt.datetime(2024, 1, 1)
    decoded = spark.createDataFrame([("a", at, 2, [0.25, 0.75], 2.0), ("b", at, 1, [1.0, 0.0], 1.0)], "uid string, ts timestamp, state int, delta array<double>, t_d double")
    resp = spark.createDataFrame([("a", 1, 1.0, 0.5), ("a", 2, 3.0, -1.0), ("b", 2, 1.0, 1.0)], "uid string, state int, intercept double, slope double")
    out = interpret.map_and_mean_response(decoded, resp)
    rows = {r["uid"]: (r["map_response"], r["mean_response"]) for r in out.collect()}
    assert rows["a"] == (1.0, 1.25) and rows["b"][0] is None
    dealt = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line]
    assert not any(", ts#" in line.split("hashpartitioning")[1] for line in dealt)
