"""Chained least squares against the same rounds over rows in memory."""

from __future__ import annotations

import math

import numpy as np
import pytest

from wattweave.operators import clean


def brute(x, gaps, cols, rounds=100):
    filled = np.where(gaps, np.nan, x)
    filled = np.where(gaps, np.nanmean(filled, axis=0), filled)
    for _ in range(rounds):
        before = filled.copy()
        for c in range(x.shape[1]):
            if gaps[:, c].any():
                design = np.column_stack([np.ones(len(x)), np.delete(filled, c, axis=1)])
                seen = ~gaps[:, c]
                beta = np.linalg.lstsq(design[seen], x[seen, c], rcond=None)[0]
                filled[gaps[:, c], c] = design[gaps[:, c]] @ beta
        if np.abs(filled - before).max() < 1e-12:
            break
    return filled[:, :cols]


def test_equals_rounds_over_rows(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(400, 2))
    x = np.column_stack([base @ [1, 2] + 50, base @ [-1, 0.5] * 10, base[:, 0] * 3 + 7, base[:, 1]]) + rng.normal(0, 0.3, (400, 4))
    gaps = rng.random((400, 4)) < [0.3, 0.2, 0.15, 0.1]
    rows = [(i, *(None if g else float(v) for v, g in zip(r, m, strict=True)), "kept") for i, (r, m) in enumerate(zip(x, gaps, strict=True))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, p double, pattern string").repartition(5)
    out = clean.impute_regression(df, ["a", "b", "c"], ["p"], method="regression")
    assert out.columns == df.columns
    got = {r["id"]: r for r in out.collect()}
    want = brute(x, gaps, 3)
    for i in range(400):
        assert np.allclose([got[i]["a"], got[i]["b"], got[i]["c"]], want[i], atol=1e-6) and got[i]["pattern"] == "kept"
        assert (got[i]["p"] is None) == gaps[i, 3]


def test_odd_tables(spark):
    schema = "a double, b double, c double"
    fill = lambda rows, cols=("a", "b"): [tuple(r) for r in clean.impute_linear(spark.createDataFrame(rows, schema), list(cols), ["c"]).collect()]
    assert fill([]) == [] and fill([(None, None, None)]) == [(None, None, None)]
    assert fill([(1.0, None, 2.0), (3.0, None, 4.0)]) == [(1.0, None, 2.0), (3.0, None, 4.0)]  # a column without any value
    line = fill([(2.0, 2.0, 1.0), (4.0, 4.0, 2.0), (None, 6.0, 3.0), (math.nan, 8.0, 4.0)])  # collinear columns: one of them is used
    assert sorted(round(r[0], 6) for r in line) == [2.0, 4.0, 6.0, 8.0]
    assert sorted(r[0] for r in fill([(5.0, 1.0, 1.0), (None, 1.0, 1.0)])) == [5.0, 5.0]  # constant
    with pytest.raises(ValueError):
        clean.impute_linear(spark.createDataFrame([(1.0, None, 1.0), (None, 1.0, 1.0)], schema), ["a", "b"], most_patterns=1)
    with pytest.raises(ValueError):
        clean.impute_regression(spark.createDataFrame([(1.0, None, 1.0)], schema), ["b"], method="other")


def test_sweep_is_least_squares():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(50), rng.normal(size=(50, 3))])
    y = x @ [1, 2, 3, 4] + rng.normal(size=50)
    all_ = np.column_stack([x, y])
    swept = clean.sweep(all_.T @ all_, [0, 1, 2, 3])
    beta, rest = np.linalg.lstsq(x, y, rcond=None)[:2]
    assert np.allclose(swept[4, :4], beta) and np.isclose(swept[4, 4], rest[0]) and np.allclose(-swept[:4, :4], np.linalg.inv(x.T @ x))
