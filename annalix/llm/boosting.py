"""Gradient-boosted trees for a binary label: histogram splits, logistic loss. For small training tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    #: A tree is (feature, bin, value) arrays of a full binary tree: node i has children 2i+1 and 2i+2; feature -1 is a leaf.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], 1).astype(np.int16)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins, out = self._bins(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = bins[rows, np.maximum(f, 0)] > cut[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += value[node]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Boosted:
    """x: (rows, features) of floats, y: 0 or 1."""
    x = np.asarray(x, float)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if len(y) else 0.5
    model = Boosted(edges, float(np.log(mean / (1 - mean))))
    b = model._bins(x)
    margin = np.full(len(x), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        grad, hess = y - p, p * (1 - p)
        size = 2 ** (depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)
        node = np.zeros(len(x), np.int64)
        for i in range(size):
            own = np.flatnonzero(node == i)
            g, h = grad[own].sum(), hess[own].sum()
            value[i] = rate * g / (h + l2)
            if i >= size // 2 or len(own) < 4:
                continue
            best = (1e-6, -1, 0)
            for k in range(x.shape[1]):
                n = len(edges[k]) + 1
                gs = np.cumsum(np.bincount(b[own, k], grad[own], n))[:-1]
                hs = np.cumsum(np.bincount(b[own, k], hess[own], n))[:-1]
                if len(gs):
                    gain = gs**2 / (hs + l2) + (g - gs) ** 2 / (h - hs + l2) - g**2 / (h + l2)
                    c = int(gain.argmax())
                    if gain[c] > best[0]:
                        best = (float(gain[c]), k, c)
            if best[1] >= 0:
                feature[i], cut[i] = best[1], best[2]
                node[own] = 2 * i + 1 + (b[own, best[1]] > best[2])
        model.trees.append((feature, cut, value))
        margin = margin + value[node]
    return model


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """A score from which on held-out rows reach the precision (1.1: none). It lies halfway between the last row that is in and the next."""
    order = np.argsort(-p, kind="stable")
    s = p[order]
    right = np.cumsum(y[order])
    ok = right / np.arange(1, len(order) + 1) >= precision
    last = np.append(s[1:] != s[:-1], True)  # equal scores go together
    ok = np.flatnonzero(ok & last)
    if not len(ok):
        return 1.1
    k = ok[-1]
    return float(s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2
