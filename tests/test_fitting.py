"""Rounds of EM over chunks: the size of a chunk doesn't matter, likelihoods are those of whole series, odd series get a defined result."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import paths
import pytest
from pyspark.sql import functions as F

from wattweave.plans import fitting, regimes

START = dt.datetime(2024, 1, 1)
ROWS = "uid string, ts timestamp, obs double, t_d double"


def series(uid, n, k, rng):
    state, out = 0, []
    for i in range(n):
        t = float(15 * math.sin(i / 12) + rng.normal())
        state = state if rng.random() < 0.9 else int(rng.integers(k))
        y = float(8 * state + (0.1 + 0.4 * state) * t + rng.normal(0, 0.5 + 0.2 * state))
        out.append((uid, START + dt.timedelta(hours=i), None if rng.random() < 0.05 else y, t))
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    return {uid: series(uid, n, k, rng) for uid, n, k in (("a", 150, 2), ("b", 90, 2), ("c", 41, 1))}


def fits(spark, rows, **options):
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    return {(r["uid"], r["k"], r["kind"], r["state"], r["to_state"]): r for r in regimes.fit_regimes(df, **options).collect()}


def told(found, uid, k):
    pick = lambda kind, *names: np.array([[found[uid, k, kind, i + 1, j][n] for n in names] for i in range(k) for j in ([0] if kind != "transition" else range(1, k + 1))])
    resp, tran = pick("response", "a", "b", "sd"), pick("transition", "a", "b").reshape(k, k, 2)
    return resp, tran, pick("init", "a")[:, 0], found[uid, k, "init", 1, 0]["loglik"]


def likelihood(rows, resp, tran, pi):
    y, x = np.array([np.nan if r[2] is None else r[2] for r in rows], float), np.array([r[3] for r in rows])
    a = fitting.moves(x[:-1], tran[..., 0], tran[..., 1])
    return paths.forward_backward(fitting.log_density(y, x, resp[:, :2], resp[:, 2]), a, pi)


@pytest.mark.parametrize("broadcast", [0, 32 << 20])
def test_likelihoods_are_those_of_whole_series(spark, data, monkeypatch, broadcast):
    monkeypatch.setattr(fitting, "CHUNK", 40)
    monkeypatch.setattr(fitting, "BROADCAST_BYTES", broadcast)
    rows = [r for part in data.values() for r in part]
    found = fits(spark, rows, ks=[1, 2, 3], maxit=4, restarts=2)
    assert {key[:2] for key in found} == {(u, k) for u in data for k in (1, 2, 3)}
    for uid in data:
        for k in (1, 2, 3):
            resp, tran, pi, loglik = told(found, uid, k)
            assert abs(likelihood(data[uid], resp, tran, pi)[2] - loglik) < 1e-6 * abs(loglik)
            assert list(resp[:, 1]) == sorted(resp[:, 1]) and abs(pi.sum() - 1) < 1e-9


def test_chunks_do_not_change_a_round(data):
    """Expected sums of a series in chunks, with the vectors at their bounds, are those of the series in one."""
    rng, k = np.random.default_rng(5), 3
    y, x = np.array([np.nan if r[2] is None else r[2] for r in data["a"]], float), np.array([r[3] for r in data["a"]])
    par = np.concatenate([rng.normal(0, 5, k), rng.normal(0, 0.3, k), rng.uniform(0.5, 3, k), rng.dirichlet(np.ones(k)), rng.normal(0, 1, 2 * k * k)])

    def sums(size):
        import pandas as pd

        cut = range(0, len(y), size)
        part = pd.DataFrame([("a", k, 0, i, x[at : at + size], y[at : at + size], at + size >= len(y), 1.0, 2.0, 3.0, par, 1, None, 0) for i, at in enumerate(cut)], columns=["uid", "k", "run", "chunk", "x", "y", "ends", "xm", "xs", "ym", "par", "chunks", "last", "iterations"])
        ops = fitting._folded(part, k)[["chunk", "scale", "v"]].to_dict("records")
        one = part.iloc[:1].drop(columns=["chunk"]).assign(ops=[ops])
        bounds = fitting._bounded(one, k)
        out = fitting._expected(part.merge(bounds[["chunk", "u", "w", "seen"]], on="chunk"), k)
        return np.stack(out["s"].to_list()).sum(axis=0), bounds["seen"].iloc[0]

    (want, loglik), (got, other) = sums(1000), sums(17)
    assert np.allclose(want, got, rtol=1e-8, atol=1e-8) and abs(loglik - other) < 1e-8 * abs(loglik)
    beta, sd, pi, b0, b1 = fitting._unpacked(par, k)
    gamma, xi, whole = paths.forward_backward(fitting.log_density(y - 3, (x - 1) / 2, beta, sd), fitting.moves((x[:-1] - 1) / 2, b0, b1), pi)
    assert abs(whole - loglik) < 1e-8 * abs(whole)
    assert np.allclose(want[: 6 * k].reshape(k, 6)[:, 0], gamma[~np.isnan(y)].sum(axis=0))
    p = fitting.moves((x[:-1] - 1) / 2, b0, b1)
    slope = (xi - xi.sum(axis=-1, keepdims=True) * p)[..., 1:].sum(axis=0)
    assert np.allclose(want[7 * k :][: k * (k - 1)].reshape(k, k - 1), slope)


def test_more_rounds_never_lower_the_likelihood_and_say_where_they_ended(spark, data):
    few, many = (fits(spark, data["a"], ks=[2], maxit=m, restarts=1) for m in (2, 40))
    key = ("a", 2, "init", 1, 0)
    assert many[key]["loglik"] >= few[key]["loglik"] and few[key]["iterations"] == 2 and 2 < many[key]["iterations"] <= 40
    again = fits(spark, list(reversed(data["a"])), ks=[2], maxit=2, restarts=1)
    assert abs(again[key]["loglik"] - few[key]["loglik"]) < 1e-6


def test_odd_series(spark):
    at = lambda i: START + dt.timedelta(hours=i)
    rows = [("short", at(i), 1.0, 1.0) for i in range(9)]
    rows += [("flat", at(i), 2.0, 5.0) for i in range(30)]  # nothing varies
    rows += [("empty", at(i), None, 5.0) for i in range(30)] + [("bare", at(i), 1.0, None) for i in range(30)]
    rows += [("nan", at(i), float("nan") if i % 2 else float(i), float(i)) for i in range(40)]
    rows += [(None, at(i), float(i), float(i)) for i in range(30)]
    rows += [("flat", at(3), 2.0, 5.0)] * 3  # repeated rows are rows
    found = fits(spark, rows, ks=[1, 2], maxit=5, restarts=2)
    assert {key[:2] for key in found} == {("flat", 1), ("flat", 2), ("nan", 1), ("nan", 2)}
    assert all(math.isfinite(r["loglik"]) and math.isfinite(r["a"]) for r in found.values())
    assert abs(found["flat", 1, "response", 1, 0]["a"] + 5 * found["flat", 1, "response", 1, 0]["b"] - 2) < 1e-6
    line = found["nan", 1, "response", 1, 0]
    assert abs(line["a"]) < 1e-6 and abs(line["b"] - 1) < 1e-6


def test_chosen_sizes_are_fitted_again(spark, data):
    df = spark.createDataFrame([r for part in data.values() for r in part], ROWS)
    chosen = spark.createDataFrame([("a", 2, True), ("a", 1, False), ("b", 1, True), ("gone", 1, True)], "uid string, k int, chosen boolean")
    again = regimes.refit_chosen(df, chosen, maxit=3)
    assert {(r["uid"], r["k"]) for r in again.select("uid", "k").distinct().collect()} == {("a", 2), ("b", 1)}
    assert regimes.refit_chosen(df, chosen.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("broadcast", [0, 32 << 20])
def test_series_in_one_piece_and_in_rounds_over_chunks_are_fitted_alike(spark, data, monkeypatch, broadcast):
    monkeypatch.setattr(fitting, "CHUNK", 40)
    monkeypatch.setattr(fitting, "BROADCAST_BYTES", broadcast)
    rows, found = [r for part in data.values() for r in part], []
    for whole in (8, 2, 0):  # all in one piece, one of them, none
        monkeypatch.setattr(fitting, "WHOLE", whole)
        found.append(fits(spark, rows, ks=[1, 2, 3], maxit=6, restarts=2))
    for other in found[1:]:
        assert other.keys() == found[0].keys()
        for key, r in found[0].items():
            assert r["iterations"] == other[key]["iterations"] and all(abs(r[c] - other[key][c]) < 1e-6 * (1 + abs(r[c])) for c in ("a", "b", "sd", "loglik"))


def test_a_short_series_takes_no_round_over_the_cluster(spark, data, monkeypatch):
    def never(*_):
        raise AssertionError("a series of one piece was cut into chunks")

    monkeypatch.setattr(fitting.passes, "pieces", never)
    assert {key[0] for key in fits(spark, data["a"], ks=[2], maxit=3, restarts=1)} == {"a"}
