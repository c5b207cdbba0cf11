"""Gradient-boosted trees for two classes: fitted on a bounded sample, applied as plain arrays."""

from __future__ import annotations

import numpy as np

BINS = 32


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3,
        weight_floor: float = 5.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic boosting with full trees of ``depth`` levels over binned features.

    Returns ``(feature, threshold, leaf, base)``: per tree the inner nodes in heap order and the
    leaf values.  ``weight_floor`` is added to the curvature of a leaf (L2 shrinkage)."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    inner, leaves = (1 << depth) - 1, 1 << depth
    rate_of = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(rate_of / (1 - rate_of)))
    score = np.full(len(y), base)
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            best, choice = np.zeros(width), [(0, None)] * width
            for j, c in enumerate(cuts):
                slot = (at - first) * (BINS + 1) + binned[:, j]
                gs = np.bincount(slot, g, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                hs = np.bincount(slot, h, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl ** 2 / (hl + weight_floor) + (ga - gl) ** 2 / (ha - hl + weight_floor) - ga ** 2 / (ha + weight_floor)
                gain = gain[:, :len(c)]
                if not gain.size:
                    continue
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                for n in np.flatnonzero(top > best + 1e-9):
                    best[n], choice[n] = top[n], (j, k[n])
            for n, (j, k) in enumerate(choice):
                if k is not None:
                    feature[t, first + n], threshold[t, first + n] = j, cuts[j][k]
            node_f, node_t = feature[t][at], threshold[t][at]
            at = 2 * at + 1 + (x[np.arange(len(x)), node_f] > node_t)
        place = at - inner
        leaf[t] = rate * np.bincount(place, g, leaves) / (np.bincount(place, h, leaves) + weight_floor)
        score += leaf[t][place]
    return feature, threshold, leaf, base


def predict(model: tuple, x: np.ndarray) -> np.ndarray:
    """Log-odds of the rows of ``x``."""
    feature, threshold, leaf, base = model
    score, rows = np.full(len(x), base), np.arange(len(x))
    for f, cut, value in zip(feature, threshold, leaf):
        at = np.zeros(len(x), np.int64)
        while at.size and at[0] < len(f):
            at = 2 * at + 1 + (x[rows, f[at]] > cut[at])
        score += value[at - len(f)]
    return score
