from __future__ import annotations

import numpy as np
import pandas as pd

from wattweave.llm import mixing


def test_small_sources_beside_a_huge_one_meet_their_targets():
    """Quotas don't get coarser with the corpus: sources of 6,400 and of 150 words beside 5 G words."""
    rng = np.random.default_rng(4)
    sizes = {"a": np.full(64, 100), "b": np.bincount(rng.integers(0, 64, 150), minlength=64), "c": rng.integers(7 * 10**7, 8 * 10**7, 64)}
    rows = [(s, k, int(n), i) for i, (s, own) in enumerate(sizes.items()) for k, n in enumerate(own) if n]
    plan = mixing.quotas(pd.DataFrame(rows, columns=["source", "shard", "size", "rank"]), {"a": 5.0, "b": 2.0, "c": 1.0})
    assert (plan["quota"] <= 3 * plan["size"]).all()
    assert (plan[plan["source"] != "c"]["quota"] == 3 * plan[plan["source"] != "c"]["size"]).all()
    got = plan.groupby("source")["quota"].sum()
    assert (got["a"], got["b"]) == (19_200, 450)
    huge = plan[plan["source"] == "c"]
    assert got["c"] == round(huge["target"].iloc[0]) and (abs(huge["quota"] / huge["size"] * huge["source_size"] / got["c"] - 1) < 1e-6).all()


def test_what_a_limit_cuts_off_goes_to_the_others():
    rng = np.random.default_rng(0)
    for _ in range(200):
        votes = rng.integers(0, 50, rng.integers(1, 7))
        limits, seats = np.where(votes > 0, rng.integers(0, 40, len(votes)), 0), int(rng.integers(0, 120))
        out = mixing.apportion(votes, limits, seats)
        assert (out <= limits).all() and out.sum() == min(seats, limits.sum())
        taken, open_ = (out > 0) & (out < limits), out < limits
        assert not taken.any() or (votes[taken] / (2 * out[taken] - 1)).min() >= (votes[open_] / (2 * out[open_] + 1)).max() * (1 - 1e-12)
