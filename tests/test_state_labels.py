"""State labels come from one pass over the rows, without a join of the rows with sums of themselves."""

from __future__ import annotations

import numpy as np

from wattweave.plans import interpret


def test_labels_need_one_pass(spark):
    rng = np.random.default_rng(4)
    rows = [(u, i, *map(float, rng.normal(size=4))) for u in (1, 2, 3) for i in range(21)]
    df = spark.createDataFrame([*rows, (None, 0, 1.0, 1.0, 1.0, 1.0)], "uid int, ts int, sd double, slope double, user double, hvac double")
    out = interpret.detect_state_labels(df, 2.0, 0.25)
    assert "Join" not in out._jdf.queryExecution().analyzed().toString()
    got = {(r["uid"], r["ts"]): (r["home"], r["hvac_on"], r["home_true"], r["hvac_true"]) for r in out.collect()}
    want = {}
    for u in (1, 2, 3):
        sd, slope, user, hvac = np.array([r[2:] for r in rows if r[0] == u]).T
        told = zip(sd > 2 * sd.min(), abs(slope) > 2 * abs(slope).min(), user > np.quantile(user, 0.25), hvac > np.quantile(hvac, 0.25))
        want |= {(u, i): tuple(map(bool, t)) for i, t in enumerate(told)}
    assert got == want
