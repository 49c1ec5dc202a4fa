"""Robust local regression against the same rule in plain loops."""

from __future__ import annotations

import math

import numpy as np
import pytest

from wattweave.plans import curves

SCHEMA = "uid string, t double, y double"


def brute(x, y, span=2 / 3, rounds=3):
    x, y = np.round(np.array(x, float)), np.array(y, float)
    n, r = len(x), np.ones(len(x))
    k = max(min(math.floor(n * span + 1e-7), n), 2)
    grid, fit = np.unique(x), {}
    for done in range(rounds + 1):
        for at in grid:
            d = np.abs(x - at)
            h = np.sort(d)[min(k, n) - 1]
            w = np.where(d <= 0.001 * h, 1.0, np.where(d <= 0.999 * h, (1 - np.minimum(d / h if h else d, 1) ** 3) ** 3, 0.0)) * r
            if w.sum() > 0:
                w = w / w.sum()
                mean = (w * x).sum()
                spread = (w * (x - mean) ** 2).sum()
                if math.sqrt(spread) > 0.001 * (x.max() - x.min()):
                    w = w * (1 + (at - mean) * (x - mean) / spread)
                fit[at] = (w * y).sum()
        e = np.abs(y - np.array([fit[v] for v in x]))
        six = 6 * np.median(e)
        if done == rounds or six < 1e-7 * e.mean():
            break
        r = np.where(e <= 0.001 * six, 1.0, np.where(e <= 0.999 * six, (1 - (e / six) ** 2) ** 2, 0.0))
    return fit


@pytest.mark.parametrize("span", [2 / 3, 0.3, 1.0])
def test_lowess_equals_plain_loops(spark, span):
    rng = np.random.default_rng(4)
    rows = []
    for uid, n in (("a", 90), ("b", 41), ("c", 7), ("d", 2), ("e", 1)):
        x = rng.uniform(40, 70, n)
        y = 3 + 0.2 * np.maximum(x - 55, 0) ** 1.5 + rng.normal(0, 0.5, n)
        y[:: 9] += 40  # outliers that the rounds must set aside
        rows += [(uid, float(a), float(b)) for a, b in zip(x, y, strict=True)]
    odd = [("a", None, 1.0), ("a", 50.0, None), ("a", math.nan, 1.0), (None, 50.0, 1.0)]
    got = {(r["uid"], r["x"]): r["fit"] for r in curves.lowess(spark.createDataFrame(rows + odd, SCHEMA).repartition(3), "y", "t", span).collect()}
    want = {(u, x): f for u in "abcde" for x, f in brute([r[1] for r in rows if r[0] == u], [r[2] for r in rows if r[0] == u], span).items()}
    assert set(got) == set(want)
    for key, fit in want.items():
        assert abs(got[key] - fit) < 1e-7 * max(1, abs(fit)), (key, got[key], fit)


def test_curve_at_whole_degrees(spark):
    rows = [("a", float(t), 2.0 * t) for t in range(50, 61, 2) for _ in range(3)]
    out = {r["grid"]: r for r in curves.robust_response_curve(spark.createDataFrame(rows, SCHEMA), "y", "t", 1, 120).collect()}
    assert len(out) == 120
    assert all(abs(out[g]["fit"] - 2 * min(max(g, 50), 60)) < 1e-9 and abs(out[g]["slope"] - 2) < 1e-9 for g in out)
    level = {r["grid"]: r for r in curves.robust_response_curve(spark.createDataFrame([("a", 50.0, 7.0)], SCHEMA), "y", "t", 49, 51).collect()}
    assert level[49]["fit"] == level[51]["fit"] == 7 and level[50]["slope"] is None
    assert curves.robust_response_curve(spark.createDataFrame([], SCHEMA), "y", "t", 1, 3).count() == 0
