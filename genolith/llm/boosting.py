"""Small gradient-boosted trees on binned features, with Platt calibration; trained in numpy from a seed, so that every run gives the same model."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, complete trees of fixed depth, Newton leaf values, splits on quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        rate = y.mean().clip(1e-3, 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        score, self.trees = np.full(len(y), self.bias), []
        inner = (1 << self.depth) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, at = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                    own = np.flatnonzero(node == k)
                    best = 1e-6
                    if len(own) >= 20:
                        total_g, total_h = g[own].sum(), h[own].sum()
                        whole = total_g**2 / (total_h + self.ridge)
                        for f, c in enumerate(cuts):
                            if not len(c):
                                continue
                            left_g = np.cumsum(np.bincount(binned[own, f], g[own], len(c) + 1))[:-1]
                            left_h = np.cumsum(np.bincount(binned[own, f], h[own], len(c) + 1))[:-1]
                            gain = left_g**2 / (left_h + self.ridge) + (total_g - left_g) ** 2 / (total_h - left_h + self.ridge) - whole
                            b = int(np.argmax(gain))
                            if gain[b] > best:
                                best, feature[k], at[k] = gain[b], f, c[b]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > at[node])
            leaf = node - inner
            value = np.bincount(leaf, g, 1 << self.depth) / (np.bincount(leaf, h, 1 << self.depth) + self.ridge) * self.rate
            self.trees.append((feature, at, value))
            score += value[leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, at, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > at[node])
            out += value[node - len(feature)]
        return out


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of P = 1 / (1 + exp(-(a * score + b))), by Newton steps on held-out scores."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * score + b)))
        w = np.maximum(p * (1 - p), 1e-6)
        grad = np.array([((y - p) * score).sum() - 1e-3 * a, (y - p).sum()])
        hess = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum()]])
        step = np.linalg.solve(hess + 1e-9 * np.eye(2), grad)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)
