"""Fits of series with the same covariates against fits that share nothing, and how often their moves are told."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from wattweave.plans import fitting

T = 120


def series(gaps: bool) -> pd.DataFrame:
    rng = np.random.default_rng(3)
    x = np.round(10 * np.sin(np.arange(T) / 7))
    ys = [np.where(rng.random(T) < 0.3, 5 + 0.5 * x, 1.0) + rng.normal(0, 0.4, T) for _ in range(9)]
    if gaps:
        for i, y in enumerate(ys[:4]):
            y[i : 30 : i + 2] = np.nan
    levels = [np.nanquantile(y, np.arange(101) / 100).tolist() for y in ys]
    return pd.DataFrame({"uid": range(9), "xm": x.mean(), "xs": x.std(), "ym": [np.nanmean(y) for y in ys], "sy": [np.nanstd(y) for y in ys], "levels": levels, "y": ys, "x": [x] * 9, "chunk": 0, "ends": True})


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_shared_moves_give_the_same_fits(k, gaps):
    own = series(gaps).assign(k=k)
    runs = own.assign(run=[range(2)] * len(own)).explode("run")
    want = fitting._settled(runs, k, 30, 1e-6, 1, 64).sort_values(["uid", "run"])
    for most in (4, 100):  # with places that are taken again, and without
        got = fitting._alike(runs, k, 30, 1e-6, 1, 64, most).sort_values(["uid", "run"])
        assert list(got.columns) == list(want.columns) and got["done"].all()
        assert np.allclose(np.stack(got["par"].to_list()), np.stack(want["par"].to_list()), atol=1e-6)
        assert np.allclose(got["loglik"].astype(float), want["loglik"].astype(float), rtol=1e-9) and (got["iterations"].to_numpy() == want["iterations"].to_numpy()).all()


def test_careful_scales_give_the_same_sums():
    own = series(True).assign(k=3, run=0)
    c, chunks = fitting._Alike(own["x"].iloc[0]), fitting._Chunks(own)
    c.add(own, chunks)
    par = fitting._stepped(np.zeros((len(own), 30)), fitting._start_sums(chunks, own, 3, 1, 64), 3)
    (s, seen), (t, told) = c.sums(par, 3), c.sums(par, 3, careful=True)
    assert np.allclose(s, t, atol=1e-9) and np.allclose(seen, told)


def test_moves_are_told_once_for_each_distinct_covariate(monkeypatch):
    """A table of one row for each distinct covariate; before, one for each of the 120 hours."""
    tables, densities = [], fitting._Alike.densities
    monkeypatch.setattr(fitting._Alike, "densities", lambda self, par, k: (lambda told: tables.append(len(told[2])) or told)(densities(self, par, k)))
    own = series(False).assign(ks=[[1, 2]] * 9)
    out = pd.concat(fitting._asked(iter([own.drop(columns=["chunk", "ends"])]), 2, 5, 1e-6, 1, 64))
    assert len(out) == 9 + 18 and set(tables) == {len(np.unique(own["x"].iloc[0]))}
