"""Splines in gaps against a dense solve."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from wattweave.operators import clean


def dense(x, y):
    n, m = len(x), np.zeros(len(x))
    if n < 3:
        return m
    h = np.diff(x)
    a, b = np.zeros((n - 2, n - 2)), 6 * np.diff(np.diff(y) / h)
    for r in range(n - 2):
        a[r, r] = 2 * (h[r] + h[r + 1])
        if r:
            a[r, r - 1] = h[r]
        if r < n - 3:
            a[r, r + 1] = h[r + 1]
    m[1:-1] = np.linalg.solve(a, b)
    return m


@pytest.mark.parametrize("block", [1, 50, 512])
def test_bends_in_blocks_equal_a_dense_solve(spark, block):
    rng = np.random.default_rng(block)
    rows, want = [], {}
    for uid, n in (("a", 400), ("b", 3), ("c", 2), ("d", 1), ("e", 90)):
        x = np.cumsum(rng.integers(1, 6, n)).astype(float)
        y = np.sin(x / 7) * 10 + rng.normal(size=n)
        rows += [(uid, float(p), float(q)) for p, q in zip(x, y, strict=True)]
        want |= {(uid, p): m for p, m in zip(x, dense(x, y), strict=True)}
    got = {(r["key"], r["x"]): r["bend"] for r in clean.spline_bends(spark.createDataFrame(rows, "u string, x double, y double").repartition(4), "u", "x", "y", block).collect()}
    assert set(got) == set(want) and max(abs(got[k] - m) for k, m in want.items()) < 1e-9


def test_gaps_follow_the_spline(spark):
    start, f = dt.datetime(2024, 1, 1), lambda i: np.sin(i / 5)
    gone = {7, 8, 9, 20, *range(30, 50), 79}
    rows = [("a", start + dt.timedelta(hours=i), None if i in gone else float(f(i)), "kept") for i in range(80)] + [("b", start, 1.0, "kept"), ("b", start + dt.timedelta(hours=1), None, "kept"), ("b", start + dt.timedelta(hours=2), 3.0, "kept")]
    df = spark.createDataFrame(rows, "uid string, ts timestamp, obs double, i string")
    out = clean.gap_fill(df, "obs", 12, method="spline")
    assert out.columns == df.columns
    got = {(r["uid"], r["ts"]): r["obs"] for r in out.collect()}
    at = lambda i: start + dt.timedelta(hours=i)
    assert ("a", at(35)) not in got and ("a", at(79)) not in got and abs(got["b", at(1)] - 2.0) < 1e-12
    line = {(r["uid"], r["ts"]): r["obs"] for r in clean.gap_fill(df, "obs", 12).collect()}
    assert set(line) == set(got)
    for i in (7, 8, 9, 20):
        assert abs(got["a", at(i)] - f(i)) < 0.01 and abs(got["a", at(i)] - f(i)) < abs(line["a", at(i)] - f(i))
    assert clean.gap_fill(df.where("false"), "obs", method="spline").count() == 0
    with pytest.raises(ValueError):
        clean.gap_fill(df, "obs", method="other")
