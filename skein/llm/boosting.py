"""Gradient-boosted trees for small feature tables, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Binary classifier: trees of fixed depth over binned features, fitted to log loss.

    A tree of depth d is arrays of 2**d - 1 (feature, bin) splits and 2**d leaf values.
    """

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack(
            [np.searchsorted(edges, x[:, j]) for j, edges in enumerate(self.edges)], axis=1
        )

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        steps = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], steps)) for j in range(x.shape[1])]
        b, n_features = self.binned(x), x.shape[1]
        rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.base)
        offsets = np.arange(n_features) * self.bins
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            gradient, hessian = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            features = np.zeros(2**self.depth - 1, np.int64)
            cuts = np.full(2**self.depth - 1, self.bins, np.int64)
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    own = np.flatnonzero(node == k)
                    if len(own) >= 2:
                        features[k], cuts[k] = self.best_split(
                            b[own] + offsets, gradient[own], hessian[own], n_features
                        )
                node = 2 * node + 1 + (b[np.arange(len(y)), features[node]] > cuts[node])
            leaf = node - (2**self.depth - 1)
            g = np.bincount(leaf, gradient, 2**self.depth)
            h = np.bincount(leaf, hessian, 2**self.depth)
            values = -self.rate * g / (h + 1.0)
            margin += values[leaf]
            self.trees.append((features, cuts, values))
        return self

    def best_split(self, slots, gradient, hessian, n_features) -> tuple[int, int]:
        size = n_features * self.bins
        g = np.bincount(slots.ravel(), np.repeat(gradient, n_features), size)
        h = np.bincount(slots.ravel(), np.repeat(hessian, n_features), size)
        left_g = g.reshape(n_features, -1).cumsum(axis=1)
        left_h = h.reshape(n_features, -1).cumsum(axis=1)
        total_g, total_h = gradient.sum(), hessian.sum()
        gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1)
        best = int(gain.argmax())
        if gain.flat[best] <= total_g**2 / (total_h + 1) + 1e-9:
            return 0, self.bins
        return best // self.bins, best % self.bins

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Uncalibrated probabilities."""
        b, margin = self.binned(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for features, cuts, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, features[node]] > cuts[node])
            margin += values[node - len(features)]
        return 1 / (1 + np.exp(-margin))
