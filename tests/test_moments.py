"""Cross moments of asked users: the pairs of the general form, and none of them shuffled."""

from __future__ import annotations

import datetime as dt

import numpy as np

from wattweave.plans import selection
from wattweave.queries import QUERIES


def test_asked_users_meet_all_without_a_shuffle_of_pairs(spark):
    rng, day = np.random.default_rng(2), lambda i: dt.date(2024, 1, 1 + i)
    days = [(u, day(i), [float(x) for x in rng.normal(size=24)]) for u in range(45) for i in range(4)]
    days[7] = (*days[7][:2], [None, *days[7][2][1:]])
    matches = [(u, day((u + r) % 4), r) for u in range(45) for r in (1, 2, 3) if not (u == 3 and r > 1) and u != 44]
    profiles, matched = spark.createDataFrame(days, "uid long, day date, v array<double>"), spark.createDataFrame(matches, "uid long, day date, rank int")
    pairs = spark.createDataFrame(sorted({(min(q, u), max(q, u)) for q in (0, 20, 40) for u in range(45)}), "ui long, uj long")
    asked = spark.createDataFrame([(0,), (20,), (40,), (40,), (99,)], "uid long")
    key = lambda rows: {(r["ui"], r["uj"], r["hour"]): r["m"] for r in rows}
    out = selection.response_cross_moment(profiles, matched, asked=asked)
    want, rows = key(selection.response_cross_moment(profiles, matched, pairs).collect()), out.collect()
    got = key(rows)
    assert len(rows) == len(got) and got.keys() == want.keys() and len(got) == (44 * 3 - 3) * 24
    assert all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-12) for k in want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning(ui" not in plan and "SortMergeJoin" not in plan


def test_query_tells_all_pairs(spark):
    data = "/root/testdata/sf0.001"
    users = spark.read.parquet(f"{data}/events.parquet").select("user_id").distinct().count()
    out = QUERIES["response_cross_moment"](spark, data)
    told = {(r["ui"], r["uj"]) for r in out.select("ui", "uj").distinct().collect()}
    assert len(told) == users * (users + 1) // 2 and all(i <= j for i, j in told) and out.count() == 24 * len(told)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "hashpartitioning(ui" not in plan and "SortMergeJoin" not in plan
