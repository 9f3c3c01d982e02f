"""Gradient-boosted trees in numpy: histogram splits, monotonic constraints, flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """All trees in five arrays (tree x node); leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Score every row of `x` with all trees at once, one level of the trees per step."""
        if not len(self.feature):
            return np.full(len(x), self.bias)
        tree = np.arange(len(self.feature))[None, :]
        row = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(self.depth):
            low = x[row, self.feature[tree, node]] <= self.threshold[tree, node]
            node = np.where(low, self.left[tree, node], self.right[tree, node])
        return self.bias + self.value[tree, node].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points per feature: midpoints of neighbouring distinct quantiles."""
    out = []
    for column in x.T:
        q = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest"))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def fit(x, y, monotone, trees=60, depth=3, rate=0.2, bins=64, reg=1.0, least=5) -> Trees:
    """Logistic boosting. `monotone[f]` is 1, -1 or 0: the score may only rise, only fall, or do both in f.

    A split that breaks the direction of its feature is not taken, and both halves of a taken one are
    bounded by the middle of their values, so deeper splits cannot cross over. Without rows of both
    labels there are no trees and every score is the share of ones (a half when there are no rows).
    """
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    width = 2 ** (depth + 1) - 1
    if len(y) == 0 or y.min() == y.max():
        none = np.zeros((0, width), dtype=np.int64)
        return Trees(none, none.astype(float), none, none, none.astype(float), depth, bias)
    edges = _edges(x, bins)
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    margin = np.full(len(y), bias)
    parts = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _tree(codes, edges, p - y, p * (1 - p), monotone, depth, rate, reg, least, width)
        parts.append(tree[:5])
        margin += tree[5]
    return Trees(*(np.stack(a) for a in zip(*parts, strict=True)), depth, bias)


def _tree(codes, edges, g, h, monotone, depth, rate, reg, least, width):
    feature, threshold = np.zeros(width, dtype=np.int64), np.zeros(width)
    left, right, value = np.arange(width), np.arange(width), np.zeros(width)
    gain_out = np.zeros(len(g))
    todo = [(0, np.arange(len(g)), -np.inf, np.inf, 0)]
    while todo:
        node, rows, low, high, level = todo.pop()
        own = float(np.clip(-g[rows].sum() / (h[rows].sum() + reg), low, high))
        best = None
        if level < depth and len(rows) >= 2 * least:
            for f, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                c = codes[rows, f]
                sums = [np.cumsum(np.bincount(c, w, len(cuts) + 1))[:-1] for w in (g[rows], h[rows], None)]
                all_g, all_h = g[rows].sum(), h[rows].sum()
                vl = np.clip(-sums[0] / (sums[1] + reg), low, high)
                vr = np.clip(-(all_g - sums[0]) / (all_h - sums[1] + reg), low, high)
                score = -(sums[0] * vl + (sums[1] + reg) * vl * vl / 2)
                score -= (all_g - sums[0]) * vr + (all_h - sums[1] + reg) * vr * vr / 2
                fits = (sums[2] >= least) & (len(rows) - sums[2] >= least) & (monotone[f] * (vr - vl) >= 0)
                score = np.where(fits, score, -np.inf)
                k = int(np.argmax(score))
                if np.isfinite(score[k]) and (best is None or score[k] > best[0] + 1e-12):
                    best = (score[k], f, k, vl[k], vr[k])
            if best and best[0] <= -(g[rows].sum() * own + (h[rows].sum() + reg) * own * own / 2) + 1e-9:
                best = None
        if best is None:
            value[node] = rate * own
            gain_out[rows] = rate * own
            continue
        _, f, k, vl, vr = best
        feature[node], threshold[node] = f, edges[f][k]
        left[node], right[node] = 2 * node + 1, 2 * node + 2
        middle, goes = (vl + vr) / 2, codes[rows, f] <= k
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(
            monotone[f], ((low, high), (low, high))
        )
        todo.append((2 * node + 1, rows[goes], *bounds[0], level + 1))
        todo.append((2 * node + 2, rows[~goes], *bounds[1], level + 1))
    return feature, threshold, left, right, value, gain_out
