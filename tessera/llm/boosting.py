"""Gradient-boosted trees on histograms of binned features, for labels 0 and 1.

All trees are complete trees of one depth in flat arrays, so rows go down every tree by array look-ups, without a branch
for each row.  A node that is not worth a split sends all rows to the left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """feature, threshold: (trees, inner nodes), children of node i at 2 * i + 1 and 2 * i + 2; value: (trees, leaves)."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row of x."""
        depth = self.value.shape[1].bit_length() - 1 if self.value.size else 0
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Upper edges of at most `bins` bins with about as many rows each."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))
        return values
    return (values[1:] + values[:-1]) / 2


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 64, least_rows: int = 20, ridge: float = 2.0) -> Trees:
    """Trees for rows x (without NaN) and labels y; a row's score without trees is the share of label 1."""
    y = y.astype(np.float64)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    edges = [_edges(c, bins) for c in x.T] if len(x) else []
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1) if len(x) else np.zeros((0, x.shape[1]), np.int64)
    n_features, inner = x.shape[1], 2**depth - 1
    at = binned + np.arange(n_features) * bins
    total = np.full(len(x), start)
    features, thresholds, values = [], [], []
    for _ in range(trees if len(x) and 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            slot = ((node - first) * (n_features * bins))[:, None] + at
            shape = (width, n_features, bins)
            hist = [np.bincount(slot.ravel(), np.repeat(v, n_features), width * n_features * bins).reshape(shape) for v in (g, h, np.ones(len(x)))]
            gl, hl, nl = (np.cumsum(v, axis=2) for v in hist)
            gt, ht, nt = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(nl < least_rows) | (nt - nl < least_rows)] = 0
            flat = gain.reshape(width, -1)
            best = flat.argmax(axis=1)
            for k in range(width):
                if flat[k, best[k]] > 1e-6:
                    f, b = divmod(int(best[k]), bins)
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        total += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    n = len(features)
    return Trees(start, np.array(features).reshape(n, inner), np.array(thresholds).reshape(n, inner), np.array(values).reshape(n, inner + 1))
