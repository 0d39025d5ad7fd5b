"""Two-state linear-chain conditional random field over many short chains at once.

All chains of a batch stand in one array; a flag marks where one begins. Forward
and backward run over blocks side by side, with one small pass over the blocks'
transfer matrices, so a chain's marginals do not depend on what shares its batch.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128


def _blocks(score: np.ndarray, begins: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Transfer matrices as an array (BLOCK, lanes, 2, 2); padding is the identity."""
    n = len(score)
    lanes = -(-n // BLOCK)
    e = np.clip(score, -40, 40)
    psi = np.stack([np.exp(-np.maximum(e, 0)), np.exp(np.minimum(e, 0))], axis=1)
    m = np.where(begins[:, None, None], np.exp(start)[None, None, :], np.exp(trans)[None, :, :]) * psi[:, None, :]
    full = np.tile(np.eye(2), (lanes * BLOCK, 1, 1))
    full[:n] = m
    return full.reshape(lanes, BLOCK, 2, 2).transpose(1, 0, 2, 3).copy(), psi, n


def marginals(score: np.ndarray, begins: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Probability of state 1 at each place; with pairs, also the expected counts of transitions and of starts."""
    if not len(score):
        return (np.zeros(0), np.zeros((2, 2)), np.zeros(2)) if pairs else np.zeros(0)
    m, _, n = _blocks(score, begins, trans, start)
    lanes = m.shape[1]
    whole = np.tile(np.eye(2), (lanes, 1, 1))
    for t in range(BLOCK):
        whole = whole @ m[t]
        whole /= whole.max(axis=(1, 2), keepdims=True)
    into, out = np.empty((lanes, 2)), np.empty((lanes, 2))
    a0 = a1 = 0.5
    rows = whole.reshape(lanes, 4).tolist()
    for k, (p, q, r, s) in enumerate(rows):
        into[k] = a0, a1
        a0, a1 = a0 * p + a1 * r, a0 * q + a1 * s
        z = a0 + a1
        a0, a1 = a0 / z, a1 / z
    b0 = b1 = 0.5
    for k in range(lanes - 1, -1, -1):
        out[k] = b0, b1
        p, q, r, s = rows[k]
        b0, b1 = p * b0 + q * b1, r * b0 + s * b1
        z = b0 + b1
        b0, b1 = b0 / z, b1 / z
    alpha = np.empty((BLOCK + 1, lanes, 2))
    alpha[0] = into
    for t in range(BLOCK):
        a = alpha[t, :, 0, None] * m[t, :, 0] + alpha[t, :, 1, None] * m[t, :, 1]
        alpha[t + 1] = a / a.sum(axis=1, keepdims=True)
    beta = np.empty((BLOCK + 1, lanes, 2))
    beta[BLOCK] = out
    for t in range(BLOCK - 1, -1, -1):
        b = m[t, :, :, 0] * beta[t + 1, :, 0, None] + m[t, :, :, 1] * beta[t + 1, :, 1, None]
        beta[t] = b / b.sum(axis=1, keepdims=True)
    both = alpha[1:] * beta[1:]
    p = (both[..., 1] / both.sum(axis=2)).T.ravel()[:n]
    if not pairs:
        return p
    xi = alpha[:-1, :, :, None] * m * beta[1:, :, None, :]
    xi /= xi.sum(axis=(2, 3), keepdims=True)
    xi = xi.transpose(1, 0, 2, 3).reshape(-1, 2, 2)[:n]
    first = p[begins]
    return p, xi[~begins].sum(axis=0), np.array([len(first) - first.sum(), first.sum()])


def fit_chain(feature_of: np.ndarray, place_of: np.ndarray, value_of: np.ndarray | None, n_features: int, labels: np.ndarray, begins: np.ndarray, *, steps: int = 80, rate: float = 0.3, ridge: float = 1e-4):
    """Weights, transitions and starts by regularised likelihood (Adam, full batch, no randomness).

    The features are given sparsely: feature_of[i] stands at place place_of[i] with value_of[i] (1 if None).
    """
    w, trans, start = np.zeros(n_features), np.zeros((2, 2)), np.zeros(2)
    y = labels.astype(float)
    n = max(1, len(y))
    prev = np.flatnonzero(~begins)
    real = np.zeros((2, 2))
    np.add.at(real, (labels[prev - 1], labels[prev]), 1)
    real_start = np.bincount(labels[begins], minlength=2).astype(float)
    theta = [w, trans, start]
    m1 = [np.zeros_like(x) for x in theta]
    m2 = [np.zeros_like(x) for x in theta]
    for step in range(1, steps + 1):
        part = theta[0][feature_of] if value_of is None else theta[0][feature_of] * value_of
        p, xi, first = marginals(np.bincount(place_of, part, minlength=len(y)), begins, theta[1], theta[2], pairs=True)
        rest = (y - p)[place_of]
        g = [np.bincount(feature_of, rest if value_of is None else rest * value_of, minlength=n_features), real - xi, real_start - first]
        for k in range(3):
            gk = g[k] / n - ridge * theta[k]
            m1[k] = 0.9 * m1[k] + 0.1 * gk
            m2[k] = 0.99 * m2[k] + 0.01 * gk * gk
            theta[k] = theta[k] + rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-9)
    return theta


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a small logistic regression, the last for the constant (Newton's method)."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (y - p) - ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, g), -5, 5)
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
