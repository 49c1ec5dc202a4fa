"""Densities and mergeable summaries against the whole of the values."""

from __future__ import annotations

import math

import numpy as np

from wattweave.operators import describe

SCHEMA = "g string, day int, v double"


def test_summaries_merge_in_any_order(spark):
    rng = np.random.default_rng(6)
    values = {"a": rng.gamma(2, 30, 40_000), "b": np.r_[np.full(3000, 7.0), rng.normal(0, 1, 3000)], "c": np.array([4.0])}
    rows = [(g, int(i % 9), float(v)) for g, vs in values.items() for i, v in enumerate(vs)] + [("a", 1, None), ("a", 1, math.nan), ("d", 1, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    parts = describe.summary_parts(df, ["g", "day"], "v")
    direct = {r["g"]: r for r in describe.read_summaries(describe.summary_parts(df, ["g"], "v"), ["g"]).collect()}
    merged = {r["g"]: r for r in describe.read_summaries(describe.merge_summaries(parts, ["g"]), ["g"]).collect()}
    assert set(merged) == set(direct) == {"a", "b", "c"}
    worst = 0.0
    for g, vs in values.items():
        assert merged[g]["n"] == len(vs) and abs(merged[g]["mean"] - vs.mean()) < 1e-9 * max(1, abs(vs.mean()))
        if len(vs) > 1:
            assert abs(merged[g]["sd"] / vs.std(ddof=1) - 1) < 1e-9
        else:
            assert merged[g]["sd"] is None
        for p, q in zip((0.05, 0.25, 0.5, 0.75, 0.95), merged[g]["q"], strict=True):
            below, upto = (vs < q).mean(), (vs <= q).mean()
            worst = max(worst, max(0.0, below - p, p - upto)) if len(vs) > 100 else worst
    assert worst < 0.02  # of the ranks
    whole = describe.merge_summaries(parts, []).collect()
    assert len(whole) == 1 and whole[0]["n"] == sum(map(len, values.values()))
    assert describe.merge_summaries(parts.where("false"), ["g"]).count() == 0


def test_density_is_that_of_the_binned_values(spark):
    rng = np.random.default_rng(7)
    v = np.r_[rng.normal(5, 1, 500), [-100.0, 100.0]]
    df = spark.createDataFrame([("a", 0, float(x)) for x in v] + [("a", 0, None), ("a", 0, math.nan)], SCHEMA)
    out = sorted(describe.densities(df, ["g"], "v", 0.0, 10.0, 40, 0.5).collect(), key=lambda r: r["bin"])
    counts = np.histogram(np.clip(v, 0, 9.999), 40, (0, 10))[0]
    assert [r["n"] for r in out] == counts.tolist()
    x = (np.arange(40) + 0.5) / 4
    want = (counts[None] * np.exp(-0.5 * ((x[:, None] - x[None]) / 0.5) ** 2)).sum(axis=1) / (len(v) * 0.5 * math.sqrt(2 * math.pi))
    assert np.allclose([r["density"] for r in out], want) and abs(sum(r["density"] for r in out) / 4 - 1) < 0.02
    assert describe.densities(df.where("false"), ["g"], "v", 0.0, 1.0).count() == 0
