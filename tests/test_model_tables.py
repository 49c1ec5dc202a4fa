"""Sizes and shares of the model tables come from one count of the states, not from the hours anew."""

from __future__ import annotations

from wattweave import queries
from wattweave.sources import sinks

DATA = "/root/testdata/sf0.001"


def test_sizes_and_shares_read_counts(spark, monkeypatch):
    plans = {}
    kept = sinks.save_models

    def save(tables, path):
        plans.update({name: df._jdf.queryExecution().optimizedPlan().toString() for name, df in tables.items()})
        kept(tables, path)

    monkeypatch.setattr(sinks, "save_models", save)
    got = {r["part"]: r for r in queries.model_tables(spark, DATA).collect()}
    assert not any("Window" in plans[name] for name in ("model_perf", "contributions"))
    assert got["decoded"]["n"] == got["model_perf"]["total"] and abs(got["contributions"]["total"] - got["model_perf"]["n"]) < 1e-6
