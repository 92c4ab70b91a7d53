"""A small logistic regression in numpy, for bounded training samples on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Rows:
    """A 0/1 matrix: row i has the columns flat[bounds[i]:bounds[i+1]]."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.flat = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        self.owner, self.n, self.width = np.repeat(np.arange(len(rows)), self.sizes), len(rows), width

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights[self.flat], self.n)

    def back(self, residual: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, residual[self.owner], self.width)


def fit(x: Rows, y: np.ndarray, l2: float = 1e-3, swapped: tuple[Rows, Rows] | None = None, fairness: float = 0.0, steps: int = 300, sample_weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias of the regularised model, by Adam on the whole sample.

    ``swapped`` are pairs of rows whose scores should agree; their squared difference times
    ``fairness`` is part of the loss.
    """
    w, b = np.zeros(x.width), 0.0
    share = np.ones(x.n) if sample_weight is None else sample_weight
    share = share / max(share.sum(), 1e-9)
    m, v, mb, vb = np.zeros(x.width), np.zeros(x.width), 0.0, 0.0
    for t in range(1, steps + 1):
        r = (sigmoid(x.times(w) + b) - y) * share
        g, gb = x.back(r) + l2 * w / max(x.n, 1) ** 0.5, r.sum()
        if swapped and swapped[0].n and fairness:
            gap = (swapped[0].times(w) - swapped[1].times(w)) * (2 * fairness / swapped[0].n)
            g += swapped[0].back(gap) - swapped[1].back(gap)
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.1 * (1 - t / (steps + 1))
        a, c = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a) / (np.sqrt(v / c) + 1e-8)
        b -= rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    return w, float(b)


def informative(columns: np.ndarray, n: np.ndarray, pos: np.ndarray, total: float, positive: float, most: int) -> np.ndarray:
    """Of columns that n rows (pos of them positive) have, those that tell most about y, sorted."""
    p0 = positive / total

    def gain(k: np.ndarray, m: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(k * np.log(k / (m * p0))) + np.nan_to_num((m - k) * np.log((m - k) / (m * (1 - p0))))

    g = gain(pos, n) + gain(positive - pos, total - n)
    g[g < 6] = 0
    best = np.lexsort((columns, -g))[:most]
    return np.sort(columns[best[g[best] > 0]])
