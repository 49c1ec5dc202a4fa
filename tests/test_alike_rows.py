"""Fits of families read a table of distinct rows, and count each as often as it occurs."""

from __future__ import annotations

from wattweave.plans import families


def test_rows_that_are_alike_are_one(spark, monkeypatch):
    stored, store = [], families.cut_lineage

    def keep(df):
        stored.append(store(df))
        return stored[-1]

    monkeypatch.setattr(families, "cut_lineage", keep)
    cells = {(0.0, 0.0): 30, (0.0, 1.0): 10, (1.0, 0.0): 10, (1.0, 1.0): 30}
    df = spark.createDataFrame([c for c, n in cells.items() for _ in range(n)] + [(None, 1.0)] * 5, "x double, on double")
    told = families.fit_families(df, 1, [families.Regression("on", ["x"], "binomial")], iterations=50, tol=1e-15)
    got = {r["parameter"]: r["value"] for r in told.collect()}
    assert abs(got["(intercept)"] + 1.0986122886681098) < 1e-6 and abs(got["x"] - 2.1972245773362196) < 1e-6  # logit 1/4, logit 3/4 - logit 1/4
    assert [t.count() for t in stored] == [4]
