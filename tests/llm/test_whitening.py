from __future__ import annotations

import math

import numpy as np
import pytest

from wattweave.llm import spectrum, whitening
from wattweave.llm.queries import op12_embedding_whitening

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(vectors):
    """(ids, x, n, S, eigenvalues, vectors, trace) of plain numpy over the kept rows."""
    rows = [(k, v) for k, v in vectors if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * c) for c in v] for _, v in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = fit - s / n
    values, vecs = np.linalg.eigh(y.T @ y / n)
    return [k for k, _ in rows], x, n, s, values[::-1], vecs[:, ::-1], np.trace(y.T @ y / n)


def same(rows, vectors, k=4):
    ids, x, n, s, values, vecs, trace = brute(vectors)
    k = min(k, x.shape[1])
    assert len(rows) == k * len(ids)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9
    w = (x - s / n) @ vecs[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        mine = np.array([got[i, c + 1]["whitened"] for i in ids])
        assert min(np.abs(mine - w[:, c]).max(), np.abs(mine + w[:, c]).max()) < 1e-7
        assert got[ids[0], c + 1]["explained"] == pytest.approx(values[c] / trace, rel=1e-9)
    for i, row in zip(ids, x, strict=True):
        assert got[i, 1]["n"] == n and got[i, 1]["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True))


def test_whole_table(spark, sf):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same(op12_embedding_whitening(spark, sf).collect(), table)


def test_odd_rows(spark, clash):
    rng = np.random.default_rng(3)
    good = [(i, (rng.standard_normal(6) * [5, 3, 2, 1, 0.5, 0.1]).tolist(), 1) for i in range(200)]
    copies = [(1000 + i, good[0][1], 2) for i in range(150)]  # a hot vector counts once
    bad = [(2000, None, 1), (2001, [1.0, None] + [0.0] * 4, 1), (2002, [math.nan] + [0.0] * 5, 1), (2003, [math.inf] + [0.0] * 5, 1), (2004, [], 1)]
    far = [(3000, [2.0**12] + [0.0] * 5, 1)]
    table = clash(spark.createDataFrame(good + copies + bad + far, SCHEMA).drop("label").repartition(7))
    got = whitening.whiten(table).withColumnRenamed("id", "vec_id").collect()
    same(got, [(k, v) for k, v, _ in good + copies + far])
    again = whitening.whiten(table.repartition(3)).collect()
    assert {(r["id"], r["component"], r["whitened"]) for r in again} == {(r["vec_id"], r["component"], r["whitened"]) for r in got}
    shorter = spark.createDataFrame(good + [(1, [1.0, 2.0], 1), (None, good[1][1], 1)], SCHEMA)
    ids = [r["id"] for r in whitening.whiten(shorter).collect()]
    assert len(ids) == 4 * 201 and ids.count(None) == 4


def test_without_variance(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert make([]) == make([(1, None, 0)]) == make([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]) == []
    line = make([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(5)])
    assert [r["component"] for r in line] == [1] * 5 and {round(r["explained"], 12) for r in line} == {1.0}
    ties = make([(i, [float(a), float(b), float(c), 0.0], 0) for i, (a, b, c) in enumerate(np.ndindex(2, 2, 2))])
    assert len(ties) == 24 and {round(r["explained"], 12) for r in ties} == {round(1 / 3, 12)} and ties[0]["identity_error"] < 1e-9


def test_exact_sums():
    rng = np.random.default_rng(1)
    for most in (3, 1 << 20, 1 << 26, 1 << 30, 1 << 40):
        z = rng.integers(-most, most, (50, 4))
        assert (whitening.exact_gram(z) == z.astype(object).T @ z.astype(object)).all()
    n = 1 << 30
    model = whitening.Whitener(2, [1, 1], np.array([[1, 0], [0, 1]], object), 2)
    model.n = n
    assert model.deviation(np.array([[1, 0], [1 << 38, 0]]))[1] is None


@pytest.mark.parametrize("dim", [1, 2, 3, 8, 40])
def test_spectrum(dim):
    rng = np.random.default_rng(dim)
    q = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    for values in (rng.random(dim), np.ones(dim), np.r_[np.full(min(dim, 3), 5.0), rng.random(max(0, dim - 3))], np.r_[1, 1 + 1e-9, rng.random(dim)][:dim], 10.0 ** -np.arange(dim), np.zeros(dim)):
        a = q @ np.diag(values) @ q.T
        a = (a + a.T) / 2
        found, vectors = spectrum.leading(a, 4)
        k = min(dim, 4)
        assert np.abs(found - np.sort(values)[::-1][:k]).max() < 1e-13 * max(1, dim)
        assert np.abs(a @ vectors - vectors * found).max() < 1e-13 and np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
        for shift in (-0.5, 0.3, 0.9999, 2.0):
            assert spectrum.count_below(a, shift) == (np.linalg.eigvalsh(a) < shift).sum()
