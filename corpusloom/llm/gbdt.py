"""Gradient-boosted trees for two classes on small dense feature tables, in numpy."""

from __future__ import annotations

import numpy as np


class GradientBoosting:
    """Logistic loss, histogram splits, trees of fixed depth. fit() is meant for a bounded sample; predict() is vectorised."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 1.0, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> GradientBoosting:
        n, k = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        b = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        score = np.full(n, self.start)
        nodes = 2**self.depth
        self.feature = np.zeros((self.trees, nodes), np.int64)
        self.threshold = np.full((self.trees, nodes), np.inf)
        self.value = np.zeros((self.trees, nodes))
        for t in range(self.trees):
            q = 1 / (1 + np.exp(-score))
            g, h = y - q, q * (1 - q)
            node = np.ones(n, np.int64)
            for level in range(self.depth):
                count = 2**level
                first = node - count
                best = np.zeros(count)
                for j in range(k):
                    m = len(self.edges[j]) + 1
                    if m == 1:
                        continue
                    cell = first * m + b[:, j]
                    gs = np.cumsum(np.bincount(cell, g, count * m).reshape(count, m), 1)
                    hs = np.cumsum(np.bincount(cell, h, count * m).reshape(count, m), 1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hl < self.least) | (ht - hl < self.least)] = 0
                    at = np.argmax(gain, 1)
                    top = gain[np.arange(count), at]
                    better = top > best + 1e-9
                    best = np.where(better, top, best)
                    self.feature[t, count : 2 * count][better] = j
                    self.threshold[t, count : 2 * count][better] = self.edges[j][at[better]]
                node = 2 * node + (x[np.arange(n), self.feature[t, node]] > self.threshold[t, node])
            leaf = node - nodes
            self.value[t] = self.rate * np.bincount(leaf, g, nodes) / (np.bincount(leaf, h, nodes) + self.l2)
            score += self.value[t, leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for t in range(self.trees):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (x[rows, self.feature[t, node]] > self.threshold[t, node])
            score += self.value[t, node - 2**self.depth]
        return 1 / (1 + np.exp(-score))
