"""Leading eigenpairs of a symmetric matrix by slicing its spectrum.

The inertia of A - s I, read from an LDL' factorisation with diagonal pivots of
one or two rows, counts the eigenvalues below s. Bisection by such counts
encloses each leading eigenvalue alone, or a cluster that double precision can't
part; Rayleigh quotient iteration finishes within the enclosure; two more counts
certify that the eigenvalue found has the number asked for.
"""

from __future__ import annotations

import numpy as np

#: Where 2 x 2 pivots take over, the value that bounds growth best.
ALPHA = (1 + 17**0.5) / 8


def count_below(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``a`` below ``shift``: negative ones among the blocks of D in P(a - shift I)P' = L D L'."""
    m = a - shift * np.eye(len(a))
    below = 0
    while len(m):
        diagonal = np.abs(np.diagonal(m))
        r = int(diagonal.argmax())
        off = np.abs(m).copy()
        np.fill_diagonal(off, 0.0)
        p, q = divmod(int(off.argmax()), len(m)) if len(m) > 1 else (0, 0)
        if diagonal[r] == 0.0 and off[p, q] == 0.0:
            break
        if diagonal[r] >= ALPHA * off[p, q]:
            picked = [r]
            below += int(m[r, r] < 0)
        else:
            picked = [p, q]
            below += 1  # the determinant of such a block is negative: one eigenvalue on either side
        rest = np.setdiff1d(np.arange(len(m)), picked, assume_unique=True)
        block, side = m[np.ix_(picked, picked)], m[np.ix_(rest, picked)]
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        m = (m + m.T) / 2
    return below


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of ``a``, falling, and their unit eigenvectors as columns.

    The largest component of each vector is positive. Vectors of equal
    eigenvalues are an orthonormal basis of their space.
    """
    n = len(a)
    k = min(k, n)
    if not a.any():
        return np.zeros(k), np.eye(n)[:, :k]
    radius = np.abs(a).sum(axis=1) - np.abs(np.diagonal(a))
    low, high = float((np.diagonal(a) - radius).min()), float((np.diagonal(a) + radius).max())
    scale = max(abs(low), abs(high), np.finfo(float).tiny)
    # Width that double precision can tell apart: enclosures don't get narrower.
    least = 64 * np.finfo(float).eps * scale
    low, high = low - least, high + least
    counts: dict[float, int] = {low: 0, high: n}

    def below(s: float) -> int:
        if s not in counts:
            counts[s] = count_below(a, s)
        return counts[s]

    values, vectors = np.empty(0), np.empty((n, 0))
    while len(values) < k:
        # Bracket number n - len(values), counted from below, by the counts there are, then halve.
        place = n - len(values)
        lo = max(s for s, c in counts.items() if c < place)
        hi = min(s for s, c in counts.items() if c >= place)
        # Alone, and with room around for the iteration to settle on it; or too narrow to part.
        while (below(hi) - below(lo) > 1 or hi - lo > 1e-3 * scale) and hi - lo > least:
            middle = (lo + hi) / 2
            if below(middle) < place:
                lo = middle
            else:
                hi = middle
        size = min(below(hi) - below(lo), place)
        found, basis = _finish(a, lo, hi, size, vectors)
        # certificate: nothing of this number lies outside of what the values span
        slack = 16 * least
        while below(float(found.max()) + slack) < place or below(float(found.min()) - slack) > place - size:
            lo, hi = _narrower(below, lo, hi, place, least)
            if hi - lo <= least:
                found, basis = _finish(a, lo, hi, size, vectors, by_shift=True)
                break
            size = min(below(hi) - below(lo), place)
            found, basis = _finish(a, lo, hi, size, vectors)
        values, vectors = np.concatenate([values, found]), np.hstack([vectors, basis])
    values, vectors = values[:k], vectors[:, :k]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])
    return values, vectors * np.where(signs == 0, 1.0, signs)


def _narrower(below, lo: float, hi: float, place: int, least: float) -> tuple[float, float]:
    for _ in range(8):
        if hi - lo > least:
            middle = (lo + hi) / 2
            lo, hi = (middle, hi) if below(middle) < place else (lo, middle)
    return lo, hi


def _solve(a: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray:
    m = a - shift * np.eye(len(a))
    try:
        y = np.linalg.solve(m, x)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        y = np.linalg.solve(a - (shift + np.finfo(float).eps * (np.abs(a).max() + abs(shift))) * np.eye(len(a)), x)
    return y / np.abs(y).max()


def _finish(a: np.ndarray, lo: float, hi: float, size: int, known: np.ndarray, by_shift: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` eigenpairs in (lo, hi], orthogonal to ``known``: inverse iteration at the middle, then by the Rayleigh quotient if alone."""
    outside = lambda x: x - known @ (known.T @ x)
    x = np.linalg.qr(outside(np.random.default_rng(17).standard_normal((len(a), size))))[0]
    for _ in range(4):
        x = np.linalg.qr(outside(_solve(a, (lo + hi) / 2, x)))[0]
    if size == 1 and not by_shift:
        v = x[:, 0]
        best = np.inf
        for _ in range(30):
            value = float(v @ a @ v)
            off = float(np.abs(a @ v - value * v).max())
            if off >= best / 2:
                break
            best, x = off, v[:, None]
            v = outside(_solve(a, value, v))
            v /= np.linalg.norm(v)
    values, turn = np.linalg.eigh(x.T @ a @ x)  # of the cluster's own few dimensions
    return values[::-1], (x @ turn)[:, ::-1]
