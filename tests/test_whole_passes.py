"""Series passed over in one piece and by chunks give the same rows; in one piece nothing is stored but the models."""

from __future__ import annotations

import datetime as dt

import numpy as np
from test_passes import FITS, model

from wattweave.plans import passes, regimes


def test_whole_series_and_chunks_agree(spark, monkeypatch):
    rng, start = np.random.default_rng(4), dt.datetime(2024, 1, 1)
    rows = [(u, start + dt.timedelta(hours=i), None if rng.random() < 0.1 else float(rng.normal(3, 3)), float(rng.normal(0, 10))) for u, n in (("a", 90), ("b", 40), ("c", 1)) for i in range(n)]
    rows += [("b", start, 1.0, None), (None, start, 1.0, 1.0), ("nobody", start, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "uid string, ts timestamp, obs double, t_d double").repartition(3)
    fits = spark.createDataFrame([r for u, k in (("a", 2), ("b", 3), ("c", 1)) for r in model(u, k, rng)], FITS)
    monkeypatch.setattr(passes, "CHUNK", 10)
    told = []
    for whole in (0, 5, 100):  # all by chunks, "a" by chunks, none
        monkeypatch.setattr(passes, "WHOLE", whole)
        told.append({(r["uid"], r["ts"]): r for r in regimes.decode_states(df, fits, inputs=True).collect()})
    given = {(u, ts): (y, x) for u, ts, y, x in rows if x is not None}
    for got in told:
        assert len(got) == 131 and got.keys() == told[0].keys()
        for key, r in got.items():
            want = told[0][key]
            assert r["state"] == want["state"] and (r["obs"], r["t_d"]) == given[key]
            for name in ("delta", "gamma", "fit_max", "fit_avg", "loglik"):
                assert np.allclose(r[name], want[name], atol=1e-9), name


def test_short_series_are_not_stored(spark, monkeypatch):
    """Before, rows were stored in order, as chunks twice, and with their paths; and joined to their covariates again."""
    rng, start, stored, store = np.random.default_rng(5), dt.datetime(2024, 1, 1), [], passes.cut_lineage
    monkeypatch.setattr(passes, "cut_lineage", lambda df: stored.append(df.columns) or store(df))
    df = spark.createDataFrame([("a", start + dt.timedelta(hours=i), 1.0, float(i)) for i in range(50)], "uid string, ts timestamp, obs double, t_d double")
    out = regimes.decode_states(df, spark.createDataFrame(model("a", 2, rng), FITS), inputs=True)
    assert out.count() == 50 and out.columns == ["uid", "ts", "t_d", "obs", "state", "delta", "gamma", "fit_max", "fit_avg", "loglik"]
    assert stored == [["uid", "resp", "init", "tran"]]
