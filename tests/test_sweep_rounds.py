"""Rounds of the error-aware sweep: a row for each centre and hour of a task, none for each point; against plain rounds."""

from __future__ import annotations

import numpy as np

from wattweave.plans import segments


def plain(x, s, c, iterations=20):
    c, objective = c.copy(), None
    for _ in range(iterations):
        d = ((x[:, None] - c) ** 2 / s[:, None]).sum(axis=2)
        best, before, total = d.argmin(axis=1), objective, d.min(axis=1).sum()
        for k in set(best):
            c[k] = (x / s)[best == k].sum(axis=0) / (1 / s)[best == k].sum(axis=0)
        objective = total if before is None else min(total, before)
        if before is not None and before - total < 0.005 * before:
            break
    return objective


def test_sweep_sums_within_tasks(spark, monkeypatch):
    rng = np.random.default_rng(32)
    x, s = rng.normal(size=(500, 6)) + rng.integers(0, 4, (500, 1)) * 5, rng.uniform(0.2, 3, (500, 6))
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, s, strict=True))], "id int, v array<double>, s array<double>").repartition(2)
    plans, kind = [], type(df)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: plans.append(self._jdf.queryExecution().optimizedPlan().toString()) or collect(self))
    told = {r["k"]: r["objective"] for r in segments.kerror_sweep(df, [2, 4, 7]).collect()}
    start = np.array(segments._start(df, 7, "id", "v"))
    assert all(abs(told[k] / plain(x, s, start[:k]) - 1) < 1e-9 for k in (2, 4, 7))
    assert any("MapInPandas" in p for p in plans) and not any("posexplode" in p for p in plans)
