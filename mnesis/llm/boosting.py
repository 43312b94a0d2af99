"""Gradient-boosted trees for a few classes, on binned numbers, in numpy."""

from __future__ import annotations

import numpy as np


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class BoostedTrees:
    """Multi-class boosting of depth-limited trees with second-order leaf values.

    Missing numbers (NaN) fall in the lowest bin. Classes are 0 .. ``classes`` - 1.
    """

    def __init__(self, classes: int, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 2.0, least: float = 2.0):
        self.classes, self.rounds, self.depth, self.rate = classes, rounds, depth, rate
        self.bins, self.ridge, self.least = bins, ridge, least
        self.trees: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.scale, self.shift = 1.0, np.zeros(classes)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for f, cuts in enumerate(self.cuts):
            out[:, f] = np.searchsorted(cuts, np.nan_to_num(x[:, f], nan=-np.inf), side="right")
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        weight = np.ones(len(y)) if weight is None else weight
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.nanquantile(x[:, f], quantiles)) if len(x) else np.zeros(0) for f in range(x.shape[1])]
        b = self._bin(x)
        share = np.bincount(y, weight, self.classes) + 1.0
        self.base = np.log(share / share.sum())
        score = np.tile(self.base, (len(y), 1))
        hot = np.eye(self.classes)[y]
        for _ in range(self.rounds):
            p = softmax(score)
            for c in range(self.classes):
                grad, hess = weight * (p[:, c] - hot[:, c]), weight * np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
                tree = self._grow(b, grad, hess)
                self.trees.append((c, *tree))
                score[:, c] += self._leaf(b, *tree)
        return self

    def _grow(self, b: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature and cut of each inner node (a full tree, level by level), and the leaf values."""
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)
        node = np.zeros(len(grad), np.int64)
        width = self.bins + 1
        for level in range(self.depth):
            first, n = 2**level - 1, 2**level
            local = node - first
            best = np.full(n, 1e-9)
            g_all, h_all = np.bincount(local, grad, n), np.bincount(local, hess, n)
            parent = g_all**2 / (h_all + self.ridge)
            for f in range(b.shape[1]):
                key = local * width + b[:, f]
                g = np.bincount(key, grad, n * width).reshape(n, width).cumsum(axis=1)[:, :-1]
                h = np.bincount(key, hess, n * width).reshape(n, width).cumsum(axis=1)[:, :-1]
                gr, hr = g_all[:, None] - g, h_all[:, None] - h
                gain = g**2 / (h + self.ridge) + gr**2 / (hr + self.ridge) - parent[:, None]
                gain[(h < self.least * 0.1) | (hr < self.least * 0.1)] = -1
                at = gain.argmax(axis=1)
                found = gain[np.arange(n), at]
                better = found > best
                best[better] = found[better]
                feature[first : first + n][better] = f
                cut[first : first + n][better] = at[better]
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        return feature, cut, -self.rate * g / (h + self.ridge)

    def _leaf(self, b: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        return value[node - (2**self.depth - 1)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        score = np.tile(self.base, (len(x), 1))
        for c, *tree in self.trees:
            score[:, c] += self._leaf(b, *tree)
        return score

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities, calibrated if :meth:`calibrate` was called."""
        return softmax(self.raw(x) * self.scale + self.shift)

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 400, pull: float = 0.02) -> BoostedTrees:
        """Fit a temperature and a shift for each class on held-out labels (shrunk towards none)."""
        if not len(y):
            return self
        raw, hot = self.raw(x), np.eye(self.classes)[y]
        log_scale, shift = 0.0, np.zeros(self.classes)
        for _ in range(steps):
            p = softmax(raw * np.exp(log_scale) + shift)
            d = (p - hot) / len(y)
            log_scale -= 0.5 * ((d * raw).sum() * np.exp(log_scale) + pull * log_scale)
            shift -= 0.5 * (d.sum(axis=0) + pull * shift)
        self.scale, self.shift = float(np.exp(log_scale)), shift
        return self
