"""Histogram gradient-boosted trees for a yes/no target, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: node i has children 2i + 1 and 2i + 2, a value above the cut goes right.

    ``feature`` and ``cut`` are (trees, 2**depth - 1), ``leaf`` is (trees, 2**depth). A node without a split has the cut
    infinity, so everything goes left.
    """

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    @property
    def depth(self) -> int:
        return int(self.leaf.shape[1]).bit_length() - 1

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row: all rows walk down all trees level by level."""
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.leaf))
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(trees)), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.cut[trees, node])
            out[lo : lo + 4096] += self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def cut_points(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Histogram edges of each feature: midpoints between its distinct quantiles."""
    out = []
    for col in x.T:
        q = np.unique(np.quantile(col, np.linspace(0, 1, bins + 1), method="nearest")) if len(col) else np.zeros(0)
        out.append((q[1:] + q[:-1]) / 2)
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.2, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Boost log loss. ``least`` is the smallest weight of a leaf; without rows or with one class the base rate is all."""
    n, m = x.shape
    weight = np.ones(n) if weight is None else weight
    total = weight.sum()
    p = (float((weight * y).sum()) + 0.5) / (total + 1)
    base = float(np.log(p / (1 - p)))
    size = 2**depth
    feature, cut, leaf = np.zeros((trees, size - 1), np.int64), np.full((trees, size - 1), np.inf), np.zeros((trees, size))
    if not n or not 0 < (weight * y).sum() < total:
        return Trees(feature[:0], cut[:0], leaf[:0], base)
    edges = cut_points(x, bins)
    code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    width = bins + 1
    margin = np.full(n, base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = weight * (q - y), weight * q * (1 - q)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            key = (node - first)[:, None] * (m * width) + np.arange(m) * width + code
            shape = (count, m, width)
            hists = [np.bincount(key.ravel(), np.repeat(v, m), count * m * width).reshape(shape).cumsum(axis=2) for v in (g, h, weight)]
            gl, hl, wl = (v[:, :, :-1] for v in hists)
            gt, ht, wt = (v[:, :1, -1:] for v in hists)
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1
            gain[(wl < least) | (wt - wl < least)] = -1
            flat = gain.reshape(count, -1)
            best = flat.argmax(axis=1)
            for k in range(count):
                if flat[k, best[k]] > 1e-9:
                    j, b = divmod(int(best[k]), width - 1)
                    feature[t, first + k], cut[t, first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        at = node - (size - 1)
        leaf[t] = -rate * np.bincount(at, g, size) / (np.bincount(at, h, size) + ridge)
        margin += leaf[t][at]
    return Trees(feature, cut, leaf, base)
