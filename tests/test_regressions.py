"""Regressions inside response families: recovery of known draws, equality with plain least squares in memory."""

from __future__ import annotations

import math

import numpy as np
import pytest

from wattweave.plans import families, regimes
from wattweave.plans.families import LevelRegression, Normal, Poisson, Regression


def fitted(out):
    return {(r["state"], r["response"], r["parameter"]): r["value"] for r in out.collect()}


def brute_glm(x, y, family, link="log", n=None):
    """Newton steps on the log-likelihood, by numerical care only."""
    design = np.column_stack([np.ones(len(x)), x])
    n = np.ones(len(y)) if n is None else n
    beta = np.zeros(design.shape[1])
    beta[0] = {"poisson": math.log(y.mean()), "binomial": 0.0, "gamma": math.log(y.mean()) if link == "log" else 1 / y.mean(), "gaussian": y.mean()}[family]
    for _ in range(100):
        eta = design @ beta
        if family == "poisson":
            mu = np.exp(eta)
            g, w = y - mu, mu
        elif family == "binomial":
            mu = n / (1 + np.exp(-eta))
            g, w = y - mu, mu * (1 - mu / n)
        elif family == "gaussian":
            g, w = y - eta, np.ones(len(y))
        elif link == "log":
            g, w = (y - np.exp(eta)) / np.exp(eta), np.ones(len(y))
        else:
            g, w = 1 / eta - y, 1 / eta**2
        beta = beta + np.linalg.solve(design.T @ (w[:, None] * design), design.T @ g)
    return beta


def test_one_class_equals_a_plain_glm(spark):
    rng = np.random.default_rng(7)
    x, z = rng.normal(size=(2, 1000))
    u = rng.uniform(1, 5, 1000)
    draws = {
        "b": (rng.random(1000) < 1 / (1 + np.exp(-x))).astype(float),
        "p": rng.poisson(np.abs(rng.normal(2, 1, 1000))).astype(float),
        "g": rng.gamma(2.0, u / 2.0),
        "n": 1 + 2 * x - z + rng.normal(size=1000),
        "t": rng.binomial(7, 1 / (1 + np.exp(0.5 - z))).astype(float),
    }
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, z, u, *draws.values(), strict=True)], ", ".join(f"{c} double" for c in ["x", "z", "u", *draws])).withColumn("of", families.F.lit(7.0))
    responses = [Regression("b", ["x"], "binomial"), Regression("p", ["u"], "poisson"), Regression("g", ["u"], "gamma"), Regression("n", ["x", "z"]), Regression("t", ["z"], "binomial", trials="of")]
    got = fitted(families.fit_families(df.repartition(3), 1, responses, iterations=50, tol=1e-14))
    want = [("b", ["x"], x, "binomial", None), ("p", ["u"], u, "poisson", None), ("g", ["u"], u, "gamma", None), ("n", ["x", "z"], np.column_stack([x, z]), "gaussian", None), ("t", ["z"], z, "binomial", np.full(1000, 7.0))]
    for name, covariates, design, family, n in want:
        for c, v in zip(["(intercept)", *covariates], brute_glm(design, draws[name], family, n=n), strict=True):
            assert abs(got[1, name, c] - v) < 1e-6, (name, c, got[1, name, c], v)
    inverse = fitted(families.fit_families(df, 1, [Regression("g", ["u"], "gamma", "inverse")], iterations=50, tol=1e-14))
    for c, v in zip(["(intercept)", "u"], brute_glm(u, draws["g"], "gamma", "inverse"), strict=True):
        assert abs(inverse[1, "g", c] - v) < 1e-5
    assert abs(got[1, "g", "shape"] - 2) < 0.25 and abs(got[1, "n", "sd"] - 1) < 0.1


def test_known_draws_are_recovered(spark):
    """A 0/1 response with logit x, a gamma one with mean x, a three-level one that depends on a 0/1 covariate, counts with mean x."""
    rng = np.random.default_rng(11)
    n = 6000
    x, u, w = rng.normal(size=n), rng.uniform(1, 5, n), rng.integers(0, 2, n)
    levels = ["one", "two", "three"]
    shares = {0: [1 / 3] * 3, 1: np.array([1, 1, math.e]) / (2 + math.e)}
    rows = [(float(a), float(b), float(c), float(rng.random() < 1 / (1 + math.exp(-a))), float(rng.gamma(b)), levels[rng.choice(3, p=shares[int(c)])], float(rng.poisson(math.exp(0.2 + 0.5 * a)))) for a, b, c in zip(x, u, w, strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0, 0.0, 1.0, 1.0, "one", 1.0), (0.0, 1.0, 0.0, 1.0, 1.0, "four", 1.0)], "x double, u double, w double, b double, g double, m string, p double")
    got = fitted(families.fit_families(df, 1, [Regression("b", ["x"], "binomial"), Regression("g", ["u"], "gamma", "log"), LevelRegression("m", levels, ["w"]), Regression("p", ["x"], "poisson")], iterations=40))
    assert abs(got[1, "b", "(intercept)"]) < 0.12 and abs(got[1, "b", "x"] - 1) < 0.12
    assert abs(got[1, "m", "three w"] - 1) < 0.2 and abs(got[1, "m", "two w"]) < 0.2 and abs(got[1, "m", "three (intercept)"]) < 0.15
    assert abs(got[1, "p", "(intercept)"] - 0.2) < 0.06 and abs(got[1, "p", "x"] - 0.5) < 0.06
    # of a saturated model the shares are those of the table
    for level in ("two", "three"):
        for value in (0, 1):
            held = [r[5] for r in rows if r[2] == value]
            assert abs(got[1, "m", f"{level} (intercept)"] + value * got[1, "m", f"{level} w"] - math.log(held.count(level) / held.count("one"))) < 1e-3


def test_two_classes_with_slopes_of_their_own(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(3000):
        x, c = rng.uniform(-2, 2), rng.random() < 0.35
        rows.append((float(x), float(rng.poisson(math.exp(0.5 + 0.4 * x) if c else math.exp(3 - 0.3 * x))), float(rng.normal(5 if c else 0, 1)), float(rng.random() < 1 / (1 + math.exp(-(2 * x if c else -x))))))
    df = spark.createDataFrame(rows, "x double, n double, v double, b double")
    out = families.fit_families(df, 2, [Regression("n", ["x"], "poisson"), Normal("v"), Regression("b", ["x"], "binomial")], iterations=60)
    got = fitted(out)
    assert abs(out.where("state = 1").first()["weight"] - 0.65) < 0.03
    for key, value in {(1, "n", "(intercept)"): 3, (1, "n", "x"): -0.3, (2, "n", "(intercept)"): 0.5, (2, "n", "x"): 0.4, (2, "v", "mean v"): 5, (1, "b", "x"): -1, (2, "b", "x"): 2}.items():
        assert abs(got[key] - value) < 0.25, (key, got[key])
    slopes = {r["state"]: r for r in regimes.fit_mixture(df.selectExpr("n AS obs", "x AS t_d"), 2, family="poisson", slopes=True, iterations=60).collect()}
    assert sorted(round(r["slope"], 1) for r in slopes.values()) == [-0.3, 0.4]


def test_odd_tables(spark):
    schema = "x double, y double"
    fit = lambda rows, r, k=1: fitted(families.fit_families(spark.createDataFrame(rows, schema), k, [r]))
    assert fit([], Regression("y", ["x"], "poisson")) == {}
    flat = fit([(1.0, 2.0), (1.0, 4.0), (1.0, 3.0)], Regression("y", ["x"], "poisson"))  # no spread: some line through the mean
    assert abs(math.exp(flat[1, "y", "(intercept)"] + flat[1, "y", "x"]) - 3) < 1e-6
    split = fit([(float(i), float(i > 5)) for i in range(11)], Regression("y", ["x"], "binomial"))  # without a finite optimum
    assert all(map(math.isfinite, split.values()))
    with pytest.raises(ValueError):
        Regression("y", ["x"], "cauchy")
    assert fit([(0.0, 2.0), (0.0, 4.0)], Poisson("y"))[1, "y", "mean"] == 3
