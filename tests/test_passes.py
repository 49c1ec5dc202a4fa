"""The passes over chunks against the same passes in memory, step by step."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

import paths
from wattweave.plans import fitting, passes, regimes

FITS = "uid string, k int, kind string, state int, to_state int, a double, b double, sd double, loglik double, iterations int"


def model(uid, k, rng, pi=None):
    pi = rng.dirichlet(np.ones(k)) if pi is None else pi
    rows = [(uid, k, "response", i + 1, 0, float(6 * i), float(rng.normal(0, 0.2)), 1.0 + i, None, 0) for i in range(k)]
    rows += [(uid, k, "init", i + 1, 0, float(pi[i]), 0.0, 0.0, None, 0) for i in range(k)]
    return rows + [(uid, k, "transition", i + 1, j + 1, float(rng.normal(2 * (i == j), 0.5)), float(rng.normal(0, 0.05)), 0.0, None, 0) for i in range(k) for j in range(k)]


def in_memory(rows, fits, k):
    y, x = np.array([np.nan if r[2] is None else r[2] for r in rows], float), np.array([r[3] for r in rows], float)
    pick = lambda kind: sorted(f[3:8] for f in fits if f[2] == kind)
    resp, tran = np.array([f[2:] for f in pick("response")]), np.array([f[2:4] for f in pick("transition")]).reshape(k, k, 2)
    pi = np.array([f[2] for f in pick("init")])
    log_b = fitting.log_density(y, x, resp[:, :2], resp[:, 2])
    a = fitting.moves(x[:-1], tran[..., 0], tran[..., 1])
    path, delta = paths.viterbi(log_b, a, pi)
    gamma, _, loglik = paths.forward_backward(log_b, a, pi)
    mean = resp[:, 0] + np.outer(x, resp[:, 1])
    return path + 1, delta, gamma, float(loglik), mean[np.arange(len(path)), path], (delta * mean).sum(axis=1)


@pytest.mark.parametrize("chunk", [1, 7, 256])
def test_chunks_agree_with_one_pass(spark, monkeypatch, chunk):
    monkeypatch.setattr(passes, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    start, rows, fits = dt.datetime(2024, 1, 1), {}, {}
    for uid, k, n in (("a", 2, 61), ("b", 3, 100), ("c", 1, 15), ("d", 2, 1), ("e", 4, 14)):
        level = rng.integers(0, k, n)
        rows[uid] = [(uid, start + dt.timedelta(hours=i), None if rng.random() < 0.1 else float(6 * level[i // 5 * 5] + rng.normal()), float(rng.normal(0, 10))) for i in range(n)]
        fits[uid] = model(uid, k, rng, np.eye(k)[0] if uid == "b" else None)  # "b" starts in its first state for certain
    table = [r for part in rows.values() for r in part]
    table += [("a", start + dt.timedelta(days=9), 1.0, None), ("a", start + dt.timedelta(days=9), 1.0, float("nan")), ("nobody", start, 1.0, 1.0), (None, start, 1.0, 1.0)]
    df = spark.createDataFrame(table, "uid string, ts timestamp, obs double, t_d double").repartition(3)
    out = regimes.decode_states(df, spark.createDataFrame([f for part in fits.values() for f in part], FITS))
    assert "Python" not in out._jdf.queryExecution().toString() and "InPandas" not in out._jdf.queryExecution().toString()
    got = {(r["uid"], r["ts"]): r for r in out.collect()}
    assert len(got) == sum(map(len, rows.values()))
    for uid, part in rows.items():
        k = len([f for f in fits[uid] if f[2] == "init"])
        path, delta, gamma, loglik, best, mean = in_memory(part, fits[uid], k)
        for i, r in enumerate(part):
            g = got[uid, r[1]]
            assert g["state"] == path[i] and abs(g["loglik"] - loglik) < 1e-8 * max(1, abs(loglik))
            assert np.allclose(g["delta"], delta[i], atol=1e-9) and np.allclose(g["gamma"], gamma[i], atol=1e-9)
            assert abs(g["fit_max"] - best[i]) < 1e-9 and abs(g["fit_avg"] - mean[i]) < 1e-8


def test_missing_stretch_and_empty_table(spark):
    rng = np.random.default_rng(1)
    fits = spark.createDataFrame(model("a", 2, rng), FITS)
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(hours=i), None, 0.0) for i in range(700)]
    out = regimes.decode_states(spark.createDataFrame(rows, "uid string, ts timestamp, obs double, t_d double"), fits)
    total = out.agg(F.count(F.lit(1)), F.max(F.abs(F.col("loglik")))).first()
    assert total[0] == 700 and total[1] < 1e-9  # nothing seen: probability one
    assert regimes.decode_states(spark.createDataFrame([], "uid string, ts timestamp, obs double, t_d double"), fits).count() == 0


def test_one_long_series_is_spread(spark):
    rng = np.random.default_rng(2)
    fits = spark.createDataFrame(model("a", 2, rng), FITS)
    rows = spark.range(40_000).select(F.lit("a").alias("uid"), (F.timestamp_seconds(F.col("id") * 3600)).alias("ts"), (6 * (F.floor(F.col("id") / 50) % 2) + F.sin("id")).alias("obs"), F.lit(0.0).alias("t_d"))
    chunks = passes.chunked(rows, passes.model_rows(fits), "obs", "t_d", "uid", "ts")
    assert chunks.count() == 157 and chunks.rdd.getNumPartitions() >= 4
    sizes = chunks.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 100
    told = regimes.decode_states(rows, fits)
    right = told.agg(F.avg((F.col("state") == 1 + (F.floor(F.unix_timestamp("ts") / 3600 / 50) % 2)).cast("double"))).first()[0]
    assert right > 0.97
