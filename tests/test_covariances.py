"""Covariances of day vectors, and rounds of clustering that don't write their points again."""

from __future__ import annotations

import numpy as np

from wattweave.plans import segments


def test_covariances_are_those_of_numpy(spark):
    rng = np.random.default_rng(4)
    days = {u: rng.normal(1e4 * u, 3, (n, 5)) for u, n in ((1, 1), (2, 2), (3, 40))}
    rows = [(u, i, [float(x) for x in v]) for u, d in days.items() for i, v in enumerate(d)] + [(None, 0, [1.0] * 5)]
    got = {r["uid"]: r["w"] for r in segments.covariances(spark.createDataFrame(rows, "uid long, day int, v array<double>").repartition(3)).collect()}
    assert got.keys() == days.keys()
    assert all(np.allclose(np.reshape(got[u], (5, 5)), np.cov(d.T, bias=True) if len(d) > 1 else 0.0) for u, d in days.items())


def test_rounds_store_no_points(spark, monkeypatch):
    stored, store = [], segments.cut_lineage
    monkeypatch.setattr(segments, "cut_lineage", lambda df: stored.append(df.columns) or store(df))
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(i % 3 * 4, 1, 3)], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>, s array<double>")
    full, _ = segments.kerror_cluster(df, 3, full=True)
    assert full.columns == ["id", "cluster", "distance"] and full.count() == 60
    assert stored[0] == ["id", "x", "s"] and len(stored) > 1 and all(c == ["id", "cluster", "distance"] for c in stored[1:])
