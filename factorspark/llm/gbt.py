"""Gradient-boosted trees for two classes: histogram splits, logistic loss, trees of fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Trees in level order: feature and threshold of the inner nodes, and values of the leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while at[:1].size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner] if len(x) else 0.0
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boosts ``trees`` trees on rows ``x`` with classes ``y`` (0 or 1). Same data, same trees."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    coded = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) + np.arange(width) * bins
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    margin, inner = np.full(n, base), 2**depth - 1
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for k in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, here = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * (width * bins) + coded).ravel()
            g = np.bincount(cell, np.repeat(slope, width), here * width * bins).reshape(here, width, bins).cumsum(axis=2)
            h = np.bincount(cell, np.repeat(curve, width), here * width * bins).reshape(here, width, bins).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(h < least) | (all_h - h < least)] = 0
            for node in range(here):
                j, b = np.unravel_index(int(gain[node].argmax()), (width, bins))
                if gain[node, j, b] > 1e-9 and b < len(cuts[j]):
                    features[k, first + node], thresholds[k, first + node] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), features[k][at]] > thresholds[k][at])
        leaf = at - inner
        value = rate * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, curve, inner + 1) + ridge)
        values[k] = value
        margin += value[leaf]
    return Trees(features, thresholds, values, base)
