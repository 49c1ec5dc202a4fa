"""EM of regime models for all households, sizes and starts side by side, a round at a time.

A round is four steps, and Spark moves the data between them: what each chunk of
a series does to a vector of states (:func:`_folded`), a scan over the few
operators of a series for the vectors at the bounds of its chunks
(:func:`_bounded`), each chunk's expected sums given these bounds
(:func:`_expected`), and their totals by fit, from which the next parameters
follow (:func:`_improved`). A series of any length is spread over tasks; no task
needs more than a chunk's rows at a time, or two vectors and a matrix for each
chunk of a series. Fits that have ended leave the rounds. The table of models is
written at every round, so a lost executor costs one round at most.

A series of up to ``WHOLE`` chunks needs no such bounds: it is one row, and the rounds
of its fits run where it lies (:func:`_settled`, and :func:`_alike` where series have the same
covariates), with the same sums and the same step for the parameters. Rounds over the cluster are for longer series alone.

Helpers take numpy batches: many chunks, or fits, of one size at once; arrays have time
first and the batch last.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattweave.plans import passes
from wattweave.plans.passes import log_density, moves  # noqa: F401
from wattweave.storage import cut_lineage

#: Rows of a chunk.
CHUNK = 512
#: Chunks of a series that is fitted in one piece.
WHOLE = 8
#: Moves of a batch of whole series, fits x rows x states x states, at most.
CELLS = 1 << 21
#: Fits of series with the same covariates, from which on these are shared.
ALIKE = 16
_FIT = ["uid", "k", "run"]
#: What a fit carries through a round.
_HELD = ["par", "xm", "xs", "ym", "chunks", "last", "iterations"]
#: Bounds of all chunks are broadcast up to this many bytes, beyond it joined by chunk.
BROADCAST_BYTES = 32 << 20
_HELD_TYPES = "par array<double>, xm double, xs double, ym double, chunks bigint, last double, iterations int"
_STATE = "uid {uid}, k int, run int, par array<double>, xm double, xs double, ym double, chunks bigint, last double, loglik double, iterations int, done boolean"


def _unpacked(par: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """beta, sd, pi, b0, b1 of the rows of ``par``."""
    a, b, sd, pi, b0, b1 = np.split(par, [k, 2 * k, 3 * k, 4 * k, 4 * k + k * k], axis=-1)
    square = (*par.shape[:-1], k, k)
    return np.stack([a, b], axis=-1), sd, pi, b0.reshape(square), b1.reshape(square)


def _over(op: np.ufunc, m: np.ndarray, axis: int) -> np.ndarray:
    """``op`` along an axis of a few states, slice by slice: numpy's own reduction is slow on so short an axis."""
    return reduce(op, m.swapaxes(0, axis) if axis < 2 else np.moveaxis(m, axis, 0))


class _Chunks:
    """Chunks of one size of model, padded to one length, time x chunks; z and v are standardised covariate and centred observation."""

    def __init__(self, part: pd.DataFrame):
        lengths = part["x"].map(len).to_numpy()
        shape = (int(lengths.max()), len(part))
        x, y = np.zeros(shape), np.full(shape, np.nan)
        for i, (xs, ys) in enumerate(zip(part["x"], part["y"])):
            x[: len(xs), i], y[: len(ys), i] = xs, ys
        at = np.arange(shape[0])[:, None]
        self.rows = at < lengths
        self.leaves = self.rows & ~(part["ends"].to_numpy(bool) & (at == lengths - 1))
        column = lambda name: part[name].to_numpy(float)
        self.z = (x - column("xm")) / column("xs")
        self.v = y - column("ym")

    def only(self, keep: np.ndarray) -> _Chunks:
        out = object.__new__(_Chunks)
        for name, value in vars(self).items():
            setattr(out, name, np.ascontiguousarray(value[:, keep]))
        return out

    def densities(self, par: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Densities (time, state, chunk) over the largest of a row, its logarithm, and moves (time, from, to, chunk); where nothing moves, the unit matrix."""
        beta, sd, _, b0, b1 = _unpacked(par, k)
        level, slope, sd = beta[..., 0].T, beta[..., 1].T, sd.T
        logs = (self.v[:, None] - level - self.z[:, None] * slope) / sd
        logs = -0.5 * logs * logs - (np.log(sd) + 0.5 * np.log(2 * np.pi))
        logs[np.broadcast_to(np.isnan(self.v)[:, None], logs.shape)] = 0.0
        top = _over(np.maximum, logs, 1)
        logits = b0.transpose(1, 2, 0) + b1.transpose(1, 2, 0) * self.z[:, None, None]
        logits -= _over(np.maximum, logits, 2)[:, :, None]
        a = np.exp(logits, out=logits)
        a /= _over(np.add, a, 2)[:, :, None]
        for t in np.flatnonzero(~self.leaves.all(axis=1)):
            a[t][:, :, ~self.leaves[t]] = np.eye(k)[..., None]
        return np.exp(logs - top[:, None]), top, a

    def sums(self, gamma: np.ndarray, first: np.ndarray, xi: np.ndarray | None = None, a: np.ndarray | None = None) -> np.ndarray:
        """A row for each chunk: weighted moments by state, shares at the start, slope and curvature of the logits of moves."""
        _, k, n = gamma.shape
        seen = ~np.isnan(self.v)
        z, v = self.z, np.where(seen, self.v, 0.0)
        resp = np.stack([np.einsum("tn,tkn->nk", m, gamma) for m in (seen.astype(float), z * seen, z * z * seen, v, z * v, v * v)], axis=-1)
        if xi is None:
            g, h = np.zeros((n, 2 * k * (k - 1))), np.zeros((n, 3 * k * (k - 1) ** 2))
        else:
            own = self.leaves.astype(float)
            powers = (own, own * z, own * z * z)
            p, h = a[:, :, 1:], np.zeros((n, 3, k, k - 1, k - 1))
            moved = _over(np.add, xi, 2)[:, :, None] * p
            g = np.stack([np.einsum("tn,tiun->niu", m, xi[:, :, 1:] - moved) for m in powers[:2]], axis=1)
            for u in range(k - 1):
                for w in range(u + 1):
                    bend = moved[:, :, u] * (float(u == w) - p[:, :, w])
                    for at, m in enumerate(powers):
                        h[:, at, :, u, w] = h[:, at, :, w, u] = np.einsum("tn,tin->ni", m, bend)
        return np.concatenate([resp.reshape(n, -1), first, g.reshape(n, -1), h.reshape(n, -1)], axis=1)

    def swept(self, par: np.ndarray, k: int, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shares of states, shares of moves, the moves, and the log-likelihood of the rows, given shares ``u`` before a chunk and weights ``w`` of what follows it."""
        b, top, a = self.densities(par, k)
        u, w = np.ascontiguousarray(u.T), np.ascontiguousarray(w.T)
        alpha, beta, ahead, scale = np.empty_like(b), np.empty_like(b), np.empty_like(b), np.empty_like(top)
        for t in range(len(b)):
            row = u * b[t]
            scale[t] = np.maximum(_over(np.add, row, 0), 1e-300)
            alpha[t] = row / scale[t]
            u = _over(np.add, alpha[t][:, None] * a[t], 0)
        for t in reversed(range(len(b))):
            ahead[t] = w
            beta[t] = _over(np.add, a[t] * w, 1)
            w = b[t] * beta[t]
            w = w / np.maximum(_over(np.maximum, w, 0), 1e-300)
        alpha /= np.maximum(_over(np.add, alpha * beta, 1), 1e-300)[:, None]  # the same for states and moves, as beta sums moves times what follows
        gamma = alpha * beta
        xi = alpha[:, :, None] * a * ahead[:, None]
        return gamma, xi, a, ((np.log(scale) + top) * self.rows).sum(axis=0)


def _n_sums(k: int) -> int:
    return 7 * k + 2 * k * (k - 1) + 3 * k * (k - 1) ** 2


def _matrix(part: pd.DataFrame, name: str) -> np.ndarray:
    return np.stack(part[name].to_list()).astype(float)


def _by_size(use: Callable[[pd.DataFrame, int], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``use`` on the rows of each k of a batch, 256 at most at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, part in pdf.groupby("k"):
                for at in range(0, len(part), 256):
                    yield use(part.iloc[at : at + 256], int(k))

    return run


def _start_sums(c: _Chunks, part: pd.DataFrame, k: int, seed: int, size: int) -> np.ndarray:
    """Sums where states are slices of the observations by level, with noise, so that starts differ; noise is drawn by chunk, of ``size`` rows, of a series."""
    first, gamma = np.zeros((len(part), k)), np.zeros((len(c.z), k, len(part)))
    for i, r in enumerate(part.itertuples()):
        cuts = np.interp(np.arange(1, k) / k, np.linspace(0, 1, len(r.levels)), r.levels) - r.ym
        for at in range(0, len(r.x), size):
            rng, end = np.random.default_rng([seed, zlib.crc32(f"{r.uid}/{k}/{r.chunk + at // size}".encode()), r.run]), min(at + size, len(r.x))
            v = c.v[at:end, i]
            noisy = np.where(np.isnan(v), 0.0, v) + rng.normal(0, 0.3 * r.sy, size)[: end - at]
            gamma[at:end, :, i] = 0.2 * rng.dirichlet(np.ones(k), size)[: end - at] + 0.8 * np.eye(k)[np.searchsorted(cuts, noisy)]
        first[i] = 1 / k if r.chunk == 0 else 0.0
    return c.sums(gamma, first)


def _started(part: pd.DataFrame, k: int, seed: int, size: int) -> pd.DataFrame:
    return part[_FIT].assign(s=list(_start_sums(_Chunks(part), part, k, seed, size)))


def _settled(part: pd.DataFrame, k: int, maxit: int, tol: float, seed: int, size: int) -> pd.DataFrame:
    """Fits of whole series, as they stand when their last round is over."""
    c = _Chunks(part)
    held = part[[*_FIT, "xm", "xs", "ym"]].assign(chunks=1, last=np.nan, iterations=0, par=[np.zeros(4 * k + 2 * k * k)] * len(part))
    now = _improved(held.assign(s=list(_start_sums(c, part, k, seed, size)), seen=np.nan), k, maxit, tol)
    over = []
    while True:
        done = now["done"].to_numpy(bool)
        over.append(now[done])
        if done.all():
            return pd.concat(over)
        if done.any():
            now, c = now[~done], c.only(~done)
        par = _matrix(now, "par")
        gamma, xi, a, seen = c.swept(par, k, _unpacked(par, k)[2], np.ones((len(now), k)))
        now = _improved(now.assign(s=list(c.sums(gamma, gamma[0].T, xi, a)), seen=seen), k, maxit, tol)


def _total(m: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The sum over the few states of the first axis, in ``out``."""
    if len(m) == 1:
        out[:] = m[0]
    else:
        np.add(m[0], m[1], out=out)
        for row in m[2:]:
            np.add(out, row, out=out)
    return out


class _Alike:
    """Fits of whole series that have the same covariates: moves are told once for each distinct covariate, and what rows expect is added up by it."""

    def __init__(self, x: np.ndarray):
        self.x, self.at = np.unique(np.asarray(x, float), return_inverse=True)
        self.z, self.v = np.zeros((len(self.x), 0)), np.zeros((len(self.at), 0))

    def add(self, part: pd.DataFrame, c: _Chunks) -> None:
        column = lambda name: part[name].to_numpy(float)
        self.z = np.concatenate([self.z, (self.x[:, None] - column("xm")) / column("xs")], axis=1)
        self._hold(np.concatenate([self.v, c.v], axis=1))

    def only(self, keep: np.ndarray) -> None:
        self.z = np.ascontiguousarray(self.z[:, keep])
        self._hold(np.ascontiguousarray(self.v[:, keep]))

    def _hold(self, v: np.ndarray) -> None:
        self.v, self.seen = v, ~np.isnan(v)
        self.whole, self.v0 = bool(self.seen.all()), np.where(self.seen, v, 0.0)

    def densities(self, par: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As :meth:`_Chunks.densities`, but moves are (distinct covariate, from, to, series), and the logarithm is summed over rows."""
        beta, sd, _, b0, b1 = _unpacked(par, k)
        level, slope, sd = (np.ascontiguousarray(m.T) for m in (beta[..., 0], beta[..., 1], sd))
        a = b0.transpose(1, 2, 0) + b1.transpose(1, 2, 0) * self.z[:, None, None]
        a -= _over(np.maximum, a, 2)[:, :, None]
        np.exp(a, out=a)
        a /= _over(np.add, a, 2)[:, :, None]
        line, scale, tops = level + self.z[:, None] * slope, np.log(sd) + 0.5 * np.log(2 * np.pi), np.zeros(len(par))
        b = np.empty((len(self.v), k, len(par)))
        for t in range(0, len(b), 32):  # few rows at a time stay in the processor's cache
            rows = slice(t, t + 32)
            logs = self.v[rows][:, None] - line[self.at[rows]]
            logs /= sd
            logs *= -0.5 * logs
            logs -= scale
            if not self.whole:
                logs[np.broadcast_to(~self.seen[rows][:, None], logs.shape)] = 0.0
            top = _over(np.maximum, logs, 1)
            tops += top.sum(axis=0)
            logs -= top[:, None]
            np.exp(logs, out=b[rows])
        return b, tops, a

    def sums(self, par: np.ndarray, k: int, careful: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Expected sums of each fit, as those of :meth:`_Chunks.sums`, and its log-likelihood; done again with ``careful`` scales where plain ones fail."""
        b, tops, a = self.densities(par, k)
        rows, n = len(b), len(par)
        alpha, scale, cells, moved = np.empty_like(b), np.empty((rows, n)), np.empty((k, k, n)), np.zeros((len(self.x), k, k, n))
        u, turned = np.ascontiguousarray(_unpacked(par, k)[2].T), cells.swapaxes(0, 1)
        for t, d in enumerate(self.at):
            row, own = alpha[t], scale[t]
            np.multiply(u, b[t], out=row)
            np.maximum(_total(row, own), 1e-300, out=own)
            row /= own
            np.multiply(row[:, None], a[d], out=cells)
            _total(cells, u)
        logs = np.log(scale).sum(axis=0) + tops
        if not careful:
            b /= scale[:, None]
        w, beta, norm = np.ones((k, n)), np.ones((k, n)), np.ones(n)
        for t in range(rows - 1, -1, -1):
            row = alpha[t]
            if t < rows - 1:  # nothing moves after the last row
                np.multiply(a[self.at[t]], w, out=cells)
                _total(turned, beta)
            if careful:
                np.maximum(_total(row * beta, norm), 1e-300, out=norm)
                row /= norm
            if t < rows - 1:
                cells *= row[:, None]
                moved[self.at[t]] += cells
            row *= beta  # from here on the shares of states
            np.multiply(b[t], beta, out=w)
            if careful:
                w /= np.maximum(_over(np.maximum, w, 0), 1e-300)
        first, seen, value, square = alpha[0].T.copy(), np.zeros((len(self.x), k, n)), np.zeros((len(self.x), k, n)), np.zeros((k, n))
        whole = np.ones(n)
        for d in range(len(self.x)):
            own = np.flatnonzero(self.at == d)
            gamma, v = alpha[own], self.v0[own]
            if not careful:
                whole = np.minimum(whole, 1 - np.abs(_over(np.add, gamma, 1) - 1).max(axis=0))
            if not self.whole:
                gamma *= self.seen[own][:, None]
            seen[d] = gamma.sum(axis=0)
            gamma *= v[:, None]
            value[d] = gamma.sum(axis=0)
            gamma *= v[:, None]
            square += gamma.sum(axis=0)
        if not careful and not (whole > 1 - 1e-9).all():
            return self.sums(par, k, True)
        z, zz = self.z, self.z * self.z
        by = lambda m, e: np.einsum("dn,dkn->nk", m, e)
        resp = np.stack([seen.sum(axis=0).T, by(z, seen), by(zz, seen), value.sum(axis=0).T, by(z, value), square.T], axis=-1)
        p, out = a[:, :, 1:], moved.sum(axis=2)
        left = out[:, :, None] * p
        powers = (np.ones_like(z), z, zz)
        g = np.stack([np.einsum("dn,diun->niu", m, moved[:, :, 1:] - left) for m in powers[:2]], axis=1)
        h = np.zeros((n, 3, k, k - 1, k - 1))
        for i in range(k - 1):
            for j in range(i + 1):
                bend = left[:, :, i] * (float(i == j) - p[:, :, j])
                for at, m in enumerate(powers):
                    h[:, at, :, i, j] = h[:, at, :, j, i] = by(m, bend)
        flat = lambda m: m.reshape(n, -1)
        return np.concatenate([flat(resp), first, flat(g), flat(h)], axis=1), logs


def _alike(part: pd.DataFrame, k: int, maxit: int, tol: float, seed: int, size: int, most: int) -> pd.DataFrame:
    """:func:`_settled` for series with the same covariates, ``most`` at a time: where fits have ended, the next take their place."""
    c, begun, over, blank = _Alike(part["x"].iloc[0]), 0, [], 4 * k + 2 * k * k
    index, par, last, rounds = np.zeros(0, int), np.zeros((0, blank)), np.zeros(0), np.zeros(0, int)
    while begun < len(part) or len(index):
        if begun < len(part) and 2 * len(index) <= most:
            new = part.iloc[begun : begun + most - len(index)]
            chunks = _Chunks(new)
            c.add(new, chunks)
            start = _stepped(np.zeros((len(new), blank)), _start_sums(chunks, new, k, seed, size), k)
            index, par = np.concatenate([index, np.arange(begun, begun + len(new))]), np.concatenate([par, start])
            last, rounds, begun = np.concatenate([last, np.full(len(new), -np.inf)]), np.concatenate([rounds, np.zeros(len(new), int)]), begun + len(new)
        s, seen = c.sums(par, k)
        rounds = rounds + 1
        done = (rounds >= maxit) | (seen - last < tol * np.abs(seen))
        if done.any():
            ended = part.iloc[index[done]]
            over.append(ended[[*_FIT, "xm", "xs", "ym"]].assign(chunks=1, par=list(par[done]), last=seen[done], loglik=seen[done], iterations=rounds[done], done=True))
            index, par, s, seen, rounds = (m[~done] for m in (index, par, s, seen, rounds))
            c.only(~done)
        last = seen
        if len(index):
            par = _stepped(par, s, k)
    return pd.concat(over)[[*_FIT, "par", "xm", "xs", "ym", "chunks", "last", "loglik", "iterations", "done"]]


def _asked(batches: Iterator[pd.DataFrame], restarts: int, maxit: int, tol: float, seed: int, size: int) -> Iterator[pd.DataFrame]:
    """Of whole series with the sizes ``ks`` asked of each: all their fits, batch by batch."""
    for pdf in batches:
        pdf = pdf.assign(chunk=0, ends=True).explode("ks").rename(columns={"ks": "k"})
        for k, own in pdf.groupby("k"):
            runs = own.assign(run=[range(restarts if k > 1 else 1)] * len(own)).explode("run")
            most = max(1, CELLS // (int(own["x"].map(len).max()) * k * k))
            shared = runs["x"].map(lambda x: np.asarray(x, float).tobytes())
            alike = shared.map(shared.value_counts()) >= ALIKE
            for _, same in runs[alike].groupby(shared[alike]):
                yield _alike(same, int(k), maxit, tol, seed, size, int(k) * most)
            apart = runs[~alike]
            for at in range(0, len(apart), most):
                yield _settled(apart.iloc[at : at + most], int(k), maxit, tol, seed, size)


def _folded(part: pd.DataFrame, k: int) -> pd.DataFrame:
    """What each chunk does to a vector of states: rows that sum to 1, and the logarithms of their scales."""
    c = _Chunks(part)
    b, top, a = c.densities(_matrix(part, "par"), k)
    v, logs = np.repeat(np.eye(k)[..., None], len(part), axis=2), np.zeros((k, len(part)))
    for t in range(len(b)):
        v = ((v * b[t])[:, :, None] * a[t]).sum(axis=1)
        scale = np.maximum(v.sum(axis=1), 1e-300)
        v, logs = v / scale[:, None], logs + np.log(scale)
    logs = logs + (top * c.rows).sum(axis=0)
    return part[[*_FIT, *_HELD, "chunk"]].assign(scale=list(logs.T), v=list(v.reshape(k * k, -1).T))


def _bounded(part: pd.DataFrame, k: int) -> pd.DataFrame:
    """Of each fit's operators in order: shares ``u`` before each chunk, weights ``w`` of what follows it, the log-likelihood."""
    out = []
    for r in part.itertuples():
        ops = [(o["chunk"], np.asarray(o["scale"]), np.reshape(o["v"], (k, k))) for o in r.ops]
        u, loglik, us, ws = _unpacked(np.asarray(r.par), k)[2], 0.0, [], []
        for _, scale, v in ops:
            us.append(u)
            logs = np.log(np.maximum(u, 1e-300)) + scale
            row = np.exp(logs - logs.max()) @ v
            loglik, u = loglik + logs.max() + np.log(row.sum()), row / row.sum()
        w = np.ones(k)
        for _, scale, v in reversed(ops):
            ws.append(w)
            w = np.exp(scale - scale.max()) * (v @ w)
            w = np.maximum(w / w.max(), 1e-300)
        held = [getattr(r, name) for name in _HELD]
        out += [(r.uid, k, r.run, *held, o[0], u, w, loglik) for o, u, w in zip(ops, us, reversed(ws))]
    return pd.DataFrame(out, columns=[*_FIT, *_HELD, "chunk", "u", "w", "seen"])


def _expected(part: pd.DataFrame, k: int) -> pd.DataFrame:
    """Expected sums of each chunk, given what comes before and after it."""
    c = _Chunks(part)
    gamma, xi, a, _ = c.swept(_matrix(part, "par"), k, _matrix(part, "u"), _matrix(part, "w"))
    first = gamma[0].T * (part["chunk"].to_numpy() == 0)[:, None]
    return part[[*_FIT, *_HELD, "seen"]].assign(s=list(c.sums(gamma, first, xi, a)))


def _stepped(par: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """The next parameters of each fit from its expected sums: lines by weighted least squares, moves by one Newton step; the first target is the base."""
    resp, first, g, h = np.split(s[:, : _n_sums(k)], [6 * k, 7 * k, 7 * k + 2 * k * (k - 1)], axis=1)
    n, z, zz, v, zv, vv = np.moveaxis(resp.reshape(-1, k, 6), -1, 0)
    det = (n + 1e-9) * (zz + 1e-9) - z * z
    a, b = ((zz + 1e-9) * v - z * zv) / det, ((n + 1e-9) * zv - z * v) / det
    off = vv - 2 * (a * v + b * zv) + a * a * n + 2 * a * b * z + b * b * zz
    sd = np.sqrt(np.maximum(off / np.maximum(n, 1e-9), 1e-8))
    _, _, _, b0, b1 = _unpacked(par, k)
    if k > 1:
        g, h = g.reshape(-1, 2, k, k - 1), h.reshape(-1, 3, k, k - 1, k - 1)
        rows = np.concatenate([np.concatenate([h[:, i + j] for j in (0, 1)], axis=-1) for i in (0, 1)], axis=-2)
        held = np.concatenate([b0[..., 1:], b1[..., 1:]], axis=-1)
        slope = np.concatenate([g[:, 0], g[:, 1]], axis=-1) - 1e-3 * held
        held = held + np.clip(np.linalg.solve(rows + 1e-3 * np.eye(2 * (k - 1)), slope[..., None])[..., 0], -2, 2)
        none = np.zeros_like(b0[..., :1])
        b0, b1 = np.concatenate([none, held[..., : k - 1]], axis=-1), np.concatenate([none, held[..., k - 1 :]], axis=-1)
    flat = lambda m: m.reshape(len(par), -1)
    return np.concatenate([a, b, sd, first / np.maximum(first.sum(axis=1, keepdims=True), 1e-300), flat(b0), flat(b1)], axis=1)


def _improved(part: pd.DataFrame, k: int, maxit: int, tol: float) -> pd.DataFrame:
    """The next parameters of each fit; those whose likelihood no longer rises, or that have had ``maxit`` rounds, stay and are done."""
    par = _matrix(part, "par")
    new = _stepped(par, _matrix(part, "s"), k)
    seen, last, rounds = part["seen"].to_numpy(float), part["last"].to_numpy(float), part["iterations"].to_numpy(int)
    told = ~np.isnan(seen)  # the start has no likelihood yet
    rounds = rounds + told
    done = told & ((rounds >= maxit) | (seen - np.where(np.isnan(last), -np.inf, last) < tol * np.abs(seen)))
    state = part[[*_FIT, "xm", "xs", "ym", "chunks"]].assign(par=list(np.where(done[:, None], par, new)), last=seen, loglik=seen, iterations=rounds, done=done)
    return state[[*_FIT, "par", "xm", "xs", "ym", "chunks", "last", "loglik", "iterations", "done"]]


def _fit_rows(part: pd.DataFrame, k: int) -> pd.DataFrame:
    """The long table of fits; states by slope, then intercept, all on the scale of the data."""
    out = []
    for r in part.itertuples():
        beta, sd, pi, b0, b1 = _unpacked(np.asarray(r.par), k)
        slope, raw1 = beta[:, 1] / r.xs, b1 / r.xs
        level, raw0 = beta[:, 0] + r.ym - slope * r.xm, b0 - raw1 * r.xm
        order, tail = np.lexsort((level, slope)), (r.loglik, r.iterations)
        out += [(r.uid, k, "response", i + 1, 0, level[j], slope[j], sd[j], *tail) for i, j in enumerate(order)]
        out += [(r.uid, k, "init", i + 1, 0, pi[j], 0.0, 0.0, *tail) for i, j in enumerate(order)]
        out += [(r.uid, k, "transition", i + 1, m + 1, raw0[j, n], raw1[j, n], 0.0, *tail) for i, j in enumerate(order) for m, n in enumerate(order)]
    return pd.DataFrame(out, columns=["uid", "k", "kind", "state", "to_state", "a", "b", "sd", "loglik", "iterations"])


def fit(
    df: DataFrame, sizes: DataFrame, k_max: int, obs: str, t: str, key: str, ts: str, schema: str, maxit: int, tol: float, restarts: int, seed: int
) -> DataFrame:
    """The best fit of each (uid, k) of ``sizes``, as a long table; ``k_max`` is the largest k there. A random start is one only for k > 1."""
    seen = F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double")) & F.col(key).isNotNull()
    rows = cut_lineage(df.where(seen).select(F.col(key).alias("uid"), F.col(ts).alias("ts"), F.col(obs).cast("double").alias("y"), F.col(t).cast("double").alias("x")))
    long = rows.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE * CHUNK).select("uid")
    any_long = not long.isEmpty()
    models = _whole(rows.join(long, "uid", "left_anti") if any_long else rows, sizes, maxit, tol, restarts, seed)
    if any_long:
        models = models.unionByName(_spread(rows.join(long, "uid", "left_semi"), sizes, k_max, maxit, tol, restarts, seed))
    best = models.groupBy("uid", "k").agg(F.max_by(F.struct("par", "xm", "xs", "ym", "loglik", "iterations"), F.struct("loglik", -F.col("run"))).alias("m"))
    return best.select("uid", "k", "m.*").mapInPandas(_by_size(_fit_rows), schema.format(uid=dict(rows.dtypes)["uid"]))


def _told(y: Column, x: Column) -> list[Column]:
    """What starts and scales need of a series."""
    y = F.when(~F.isnan(y), y)
    return [
        F.count(y).alias("n"), F.avg(y).alias("ym"), F.stddev_pop(y).alias("sy"), F.avg(x).alias("xm"),
        F.greatest(F.stddev_pop(x), F.lit(1e-9)).alias("xs"), F.percentile_approx(y, [i / 100 for i in range(101)]).alias("levels"),
    ]


def _whole(rows: DataFrame, sizes: DataFrame, maxit: int, tol: float, restarts: int, seed: int) -> DataFrame:
    """The ended fits of series of up to ``WHOLE`` chunks, each series with all the sizes asked of it in one row."""
    series = rows.groupBy("uid").agg(*_told(F.col("y"), F.col("x")), F.array_sort(F.collect_list(F.struct("ts", "x", "y"))).alias("_r"))
    fits = sizes.groupBy("uid").agg(F.collect_set(F.col("k").cast("int")).alias("ks")).join(series.where("n > 0"), "uid")
    fits = fits.withColumn("ks", F.filter("ks", lambda k: F.col("n") >= 10 * k)).where(F.size("ks") > 0)
    of = lambda name: F.transform("_r", lambda r: r[name]).alias(name)
    stored = cut_lineage(fits.select("uid", "ks", "xm", "xs", "ym", "sy", "levels", of("y"), of("x")))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, stored.count() // 1024)  # many, so that batches of fits stay full
    state, size = _STATE.format(uid=dict(rows.dtypes)["uid"]), CHUNK
    return cut_lineage(stored.repartition(tasks).mapInPandas(lambda batches: _asked(batches, restarts, maxit, tol, seed, size), state))


def _spread(rows: DataFrame, sizes: DataFrame, k_max: int, maxit: int, tol: float, restarts: int, seed: int) -> DataFrame:
    """The ended fits of longer series, in rounds over the cluster."""
    pieces = passes.pieces(rows, "y", "x", "uid", "ts", CHUNK)
    chunks = passes.dealt(pieces.select("uid", "chunk", F.transform("rows", lambda r: r["y"]).alias("y"), F.transform("rows", lambda r: r["x"]).alias("x"), F.exists("rows", lambda r: r["last"]).alias("ends")))
    cell = chunks.select("uid", F.explode(F.arrays_zip("y", "x")).alias("r")).select("uid", "r.y", "r.x")
    spans = chunks.groupBy("uid").agg((F.max("chunk") + 1).alias("chunks"))
    told = cell.groupBy("uid").agg(*_told(F.col("y"), F.col("x")))
    runs = F.explode(F.sequence(F.lit(0), F.when(F.col("k") > 1, F.lit(restarts - 1)).otherwise(F.lit(0))))
    known = told.where("n > 0").join(spans, "uid")
    asked = cut_lineage(sizes.select("uid", F.col("k").cast("int").alias("k")).distinct().join(known, "uid").where("n >= 10 * k").select("*", runs.alias("run")))
    uid = dict(chunks.dtypes)["uid"]
    fit_of, state = f"uid {uid}, k int, run int", _STATE.format(uid=uid)
    size = CHUNK
    sums = [F.coalesce(F.sum(F.get("s", F.lit(i))), F.lit(0.0)) for i in range(_n_sums(k_max))]

    held_on = [F.any_value(name).alias(name) for name in _HELD]
    each = 8 * (6 * k_max + 2 * k_max * k_max + 16)  # bytes of a chunk's bounds with all that a fit carries
    few = (asked.agg(F.sum("chunks")).first()[0] or 0) * each <= BROADCAST_BYTES

    def improve(rows: DataFrame) -> DataFrame:
        return rows.mapInPandas(_by_size(lambda part, k: _improved(part, k, maxit, tol)), state)

    def placed(rows: DataFrame) -> DataFrame:
        """``rows`` once for each chunk of their series, with its data: joined by chunk, so that a long series is many tasks' work."""
        each = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
        return chunks.join(each, ["uid", "chunk"])

    begun = placed(asked).mapInPandas(_by_size(lambda part, k: _started(part, k, seed, size)), f"{fit_of}, s array<double>").groupBy(*_FIT).agg(F.array(*sums).alias("s"))
    held = F.array_repeat(F.lit(0.0), 4 * F.col("k") + 2 * F.col("k") * F.col("k")).alias("par")
    blank = asked.select(*_FIT, held, "xm", "xs", "ym", "chunks", F.lit(None).cast("double").alias("last"), F.lit(None).cast("double").alias("seen"), F.lit(0).alias("iterations"))
    models = cut_lineage(improve(begun.join(blank, _FIT)))
    while not models.where("NOT done").isEmpty():
        now = models.where("NOT done").select(*_FIT, *_HELD)
        folded = placed(now).mapInPandas(_by_size(_folded), f"{fit_of}, {_HELD_TYPES}, chunk bigint, scale array<double>, v array<double>")
        ops = folded.groupBy(*_FIT).agg(*held_on, F.array_sort(F.collect_list(F.struct("chunk", "scale", "v"))).alias("ops"))
        bounds = ops.mapInPandas(_by_size(_bounded), f"{fit_of}, {_HELD_TYPES}, chunk bigint, u array<double>, w array<double>, seen double")
        parts = chunks.join(F.broadcast(bounds) if few else bounds, ["uid", "chunk"]).mapInPandas(_by_size(_expected), f"{fit_of}, {_HELD_TYPES}, seen double, s array<double>")
        gathered = parts.groupBy(*_FIT).agg(*held_on, F.max("seen").alias("seen"), F.array(*sums).alias("s"))
        models = cut_lineage(improve(gathered).unionByName(models.where("done")))
    return models
