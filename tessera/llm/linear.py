"""Small sparse-linear-model pieces: row-compressed features, Adam, Platt
scaling.  They run on a bounded labelled sample; scoring runs in the tasks."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Rows:
    """Rows of a sparse matrix: flat column ids and values with row bounds."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, lengths: np.ndarray, dim: int):
        self.ids, self.values, self.dim = ids.astype(np.int32, copy=False), values.astype(np.float32, copy=False), dim
        self.row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.n = len(lengths)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.values * w[self.ids], minlength=self.n)

    def t_dot(self, c: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, weights=self.values * c[self.row], minlength=self.dim)


def adam(grad, w: np.ndarray, steps: int = 150, rate: float = 0.1) -> np.ndarray:
    """Minimise by full-batch Adam; ``grad(w)`` returns the gradient."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = grad(w)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    return w


def platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a >= 0 and b of sigmoid(a * raw + b), by damped Newton steps on smoothed labels
    (Platt 1999); one class only gives a constant near its rate."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    if pos == 0 or neg == 0 or raw.std() == 0:
        p = (pos + 1) / (pos + neg + 2)
        return 0.0, float(np.log(p / (1 - p)))
    mu, sd = raw.mean(), raw.std()
    x = np.stack([(raw - mu) / sd, np.ones(len(raw))], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = sigmoid(x @ w)
        g = x.T @ (p - t)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    a = max(w[0], 0.0) / sd
    return float(a), float(w[1] - a * mu)
