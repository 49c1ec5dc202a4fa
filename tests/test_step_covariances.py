"""All starts of a user go through each step's matrix together, as one start after the other would."""

from __future__ import annotations

import numpy as np

from wattweave.plans import interpret


def test_starts_go_together():
    rng = np.random.default_rng(5)
    steps, mu = np.arange(6), rng.normal(size=3)
    m = rng.dirichlet(np.ones(3), size=(6, 3))
    d = rng.dirichlet(np.ones(3), size=6)
    h1, h2, cov = interpret._step_covariances(steps, d.ravel(), steps, m.ravel(), mu)
    got = dict(zip(zip(h1.tolist(), h2.tolist(), strict=True), cov, strict=True))
    want = {}
    for a in range(6):
        joint = np.diag(d[a])
        for b in range(a + 1, 6):
            joint = joint @ m[b]
            want[a, b] = mu @ joint @ mu - (d[a] @ mu) * (joint.sum(axis=0) @ mu)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
