"""Gradient-boosted trees on histograms of binned features, for a logistic loss.

Fitted on a bounded sample, then flattened: all nodes of all trees stand in five
parallel arrays, and a batch of rows walks down every tree at once in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    """Node arrays of all trees; a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Of label 1, for each row of ``x``."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        node = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: int = 8) -> FlatTrees:
    """Trees for labels ``y`` (0 or 1); with no rows or one label alone, the (smoothed) share of label 1."""
    n, width = x.shape if x.size else (len(y), 0)
    share = (float(np.sum(y)) + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    none = np.zeros(0, np.int64)
    if n == 0 or width == 0 or len(np.unique(y)) < 2:
        return FlatTrees(base, none, none, np.zeros(0), none, none, np.zeros(0), 0)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        k = len(feature)
        feature.append(0), threshold.append(0.0), left.append(k), right.append(k), value.append(0.0)
        return k

    score = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        roots.append(node())
        at = np.full(n, roots[-1])
        level = [roots[-1]]
        for d in range(depth + 1):
            place = np.full(len(feature), -1)
            place[level] = np.arange(len(level))
            slot = place[at]
            live = slot >= 0
            s, gl, hl = slot[live], g[live], h[live]
            total_g, total_h = np.bincount(s, gl, len(level)), np.bincount(s, hl, len(level))
            for k, i in enumerate(level):
                value[i] = rate * total_g[k] / (total_h[k] + ridge)
            if d == depth:
                break
            best = [(1e-6, -1, 0)] * len(level)
            for f in range(width):
                cells = s * bins + binned[live, f]
                hist_g = np.bincount(cells, gl, len(level) * bins).reshape(-1, bins).cumsum(axis=1)
                hist_h = np.bincount(cells, hl, len(level) * bins).reshape(-1, bins).cumsum(axis=1)
                count = np.bincount(cells, minlength=len(level) * bins).reshape(-1, bins).cumsum(axis=1)
                rest_g, rest_h = total_g[:, None] - hist_g, total_h[:, None] - hist_h
                gain = hist_g**2 / (hist_h + ridge) + rest_g**2 / (rest_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                gain[(count < least) | (count[:, -1:] - count < least)] = 0
                gain[:, len(edges[f]) :] = 0
                cut = gain.argmax(axis=1)
                for k in range(len(level)):
                    if gain[k, cut[k]] > best[k][0]:
                        best[k] = (gain[k, cut[k]], f, cut[k])
            following = []
            for i, (_, f, cut) in zip(level, best):
                if f >= 0:
                    feature[i], threshold[i] = f, float(edges[f][cut])
                    left[i], right[i] = node(), node()
                    value[i] = 0.0
                    inside = at == i
                    low = binned[:, f] <= cut
                    at[inside & low], at[inside & ~low] = left[i], right[i]
                    following += [left[i], right[i]]
            level = following
            if not level:
                break
        score += np.asarray(value)[at]
    return FlatTrees(base, *(np.asarray(a) for a in (roots, feature, threshold, left, right, value)), depth)
