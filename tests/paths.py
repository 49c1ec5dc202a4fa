"""Viterbi and forward-backward of a whole series in memory, to hold the library against."""

from __future__ import annotations

import numpy as np


def forward_backward(log_b: np.ndarray, a: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """gamma (... x T x K), xi (... x T-1 x K x K) and the log-likelihood, scaled at each step; further runs in leading dimensions."""
    top = log_b.max(axis=-1, keepdims=True)
    b = np.exp(log_b - top)
    n = b.shape[-2]
    alpha, beta, scale = np.empty_like(b), np.ones_like(b), np.empty(b.shape[:-1])
    row = pi * b[..., 0, :]
    for t in range(n):
        if t:
            row = (alpha[..., t - 1, :, None] * a[..., t - 1, :, :]).sum(axis=-2) * b[..., t, :]
        scale[..., t] = np.maximum(row.sum(axis=-1), 1e-300)
        alpha[..., t, :] = row / scale[..., t, None]
    for t in range(n - 2, -1, -1):
        beta[..., t, :] = (a[..., t, :, :] * (b[..., t + 1, :] * beta[..., t + 1, :] / scale[..., t + 1, None])[..., None, :]).sum(axis=-1)
    gamma = alpha * beta
    gamma /= gamma.sum(axis=-1, keepdims=True)
    xi = alpha[..., :-1, :, None] * a * (b[..., 1:, :] * beta[..., 1:, :] / scale[..., 1:, None])[..., None, :]
    return gamma, xi, np.log(scale).sum(axis=-1) + top.sum(axis=(-2, -1))


def viterbi(log_b: np.ndarray, a: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest path (from 0) and the normalised scores delta of each time."""
    n, k = log_b.shape
    score, back = np.log(np.maximum(pi, 1e-300)) + log_b[0], np.zeros((n, k), dtype=int)
    delta = np.empty((n, k))
    for t in range(n):
        if t:
            step = score[:, None] + np.log(np.maximum(a[t - 1], 1e-300))
            back[t] = step.argmax(axis=0)
            score = step.max(axis=0) + log_b[t]
        score = score - score.max()
        delta[t] = np.exp(score) / np.exp(score).sum()
    path = np.empty(n, dtype=int)
    path[-1] = delta[-1].argmax()
    for t in range(n - 2, -1, -1):
        path[t] = back[t + 1, path[t + 1]]
    return path, delta
