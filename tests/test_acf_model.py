"""Autocorrelation of a value and of its model: one sort, and each value's own rows where the other is null."""

from __future__ import annotations

import datetime as dt

import numpy as np

from wattweave.operators import windows


def brute(rows, i, max_lag):
    x = np.array([r[i] for r in sorted(rows, key=lambda r: r[1]) if r[i] is not None])
    x = x - x.mean()
    return [float(x[k:] @ x[:-k] / (x @ x)) for k in range(1, max_lag + 1) if k < len(x)], len(x)


def test_one_sort_gives_both(spark):
    rng, start = np.random.default_rng(29), dt.datetime(2024, 1, 1)
    rows = [(u, start + dt.timedelta(hours=i), *(None if rng.random() < 0.2 else float(rng.normal() + i % 5) for _ in range(2))) for u in (1, 2, 3) for i in range(40)]
    rows += [(4, start, 1.0, 2.0), (4, start + dt.timedelta(hours=1), 3.0, None), (5, start, None, None), (None, start, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "uid long, ts timestamp, own double, model double").repartition(4)
    out = windows.acf_against_model(df, "own", "model", 6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1, plan
    got = {(r["uid"], r["lag"]): r for r in out.collect()}
    assert set(got) == {(u, k) for u in (1, 2, 3) for k in range(1, 7)}  # user 4's model has one row: no lag
    for u in (1, 2, 3):
        (own, n), (model, _) = (brute([r for r in rows if r[0] == u], i, 6) for i in (2, 3))
        for k in range(6):
            r = got[u, k + 1]
            assert abs(r["acf"] - own[k]) < 1e-12 and abs(r["acf_model"] - model[k]) < 1e-12 and r["significant"] == (abs(own[k]) > 1.96 / n**0.5)
    alone = {(r["uid"], r["lag"]): r["acf"] for r in windows.acf(df, "own", 6).collect()}
    assert all(abs(alone[k] - r["acf"]) < 1e-12 for k, r in got.items()) and (None, 1) not in alone and abs(alone[4, 1] + 0.5) < 1e-12
