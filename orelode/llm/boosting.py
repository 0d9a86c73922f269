"""Gradient-boosted trees on small tables of numbers, fitted by the driver on bounded samples and applied to whole batches."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic gradient boosting with shallow trees over quantile bins; deterministic."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 8, penalty: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.penalty = trees, depth, rate, bins, least, penalty
        self.start, self.forest = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
        self.start, self.forest = float(np.log(share / (1 - share))), []
        if not len(y) or y.min() == y.max():
            return self
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree: list = []
            self._grow(tree, binned, edges, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.forest.append(tree)
            score += self._tree(tree, x)
        return self

    def _grow(self, tree: list, binned: np.ndarray, edges: list, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> int:
        node = len(tree)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        tree.append((-1, 0.0, -self.rate * total_g / (total_h + self.penalty), 0, 0))
        if depth == 0 or len(rows) < 2 * self.least:
            return node
        best = (1e-6, -1, 0)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, f]
            gs, hs, ns = (np.cumsum(np.bincount(b, weights=w, minlength=len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + self.penalty) + (total_g - gs) ** 2 / (total_h - hs + self.penalty) - total_g**2 / (total_h + self.penalty)
            gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, k)
        if best[1] < 0:
            return node
        _, f, k = best
        left = binned[rows, f] <= k
        a = self._grow(tree, binned, edges, g, h, rows[left], depth - 1)
        b = self._grow(tree, binned, edges, g, h, rows[~left], depth - 1)
        tree[node] = (f, float(edges[f][k]), tree[node][2], a, b)
        return node

    def _tree(self, tree: list, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            f, cut, value, a, b = tree[node]
            if f < 0:
                out[rows] = value
                continue
            left = x[rows, f] <= cut
            stack += [(a, rows[left]), (b, rows[~left])]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the class 1 for each row."""
        x = np.asarray(x, float)
        score = np.full(len(x), self.start)
        for tree in self.forest:
            score += self._tree(tree, x)
        return 1 / (1 + np.exp(-score))
