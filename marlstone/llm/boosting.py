"""Gradient-boosted regression trees for two classes, on histograms, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees: of each inner node a feature and a threshold (greater goes right), of each leaf a value."""

    depth: int
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - len(f)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss. ridge: on leaf values. least: sum of second derivatives in a leaf, at least."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    edges = [e[e < x[:, j].max()] for j, e in enumerate(edges)]
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    # Features of two values are counted together, by one product with the rows of each node.
    flags = [j for j in range(m) if len(edges[j]) == 1]
    scales = [j for j in range(m) if len(edges[j]) > 1]
    flag_codes = codes[:, flags].astype(float)
    score = np.full(n, base)
    out = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = at - first
            g_all, h_all = (np.bincount(local, v, width) for v in (grad, hess))
            gains, places = np.zeros((width, m)), np.zeros((width, m), np.int64)

            def gain(g: np.ndarray, h: np.ndarray, g_all=g_all[:, None], h_all=h_all[:, None]) -> np.ndarray:
                gr, hr = g_all - g, h_all - h
                out = g**2 / (h + ridge) + gr**2 / (hr + ridge) - g_all**2 / (h_all + ridge)
                out[(h < least) | (hr < least)] = 0
                return out

            if flags:
                rows = np.zeros((2, width, n))
                rows[0, local, np.arange(n)], rows[1, local, np.arange(n)] = grad, hess
                right = rows @ flag_codes
                gains[:, flags] = gain(g_all[:, None] - right[0], h_all[:, None] - right[1])
            for j in scales:
                key = local * bins + codes[:, j]
                g, h = (np.bincount(key, v, width * bins).reshape(width, bins).cumsum(1) for v in (grad, hess))
                of = gain(g, h)
                of[:, len(edges[j]) :] = 0
                places[:, j] = of.argmax(1)
                gains[:, j] = of[np.arange(width), places[:, j]]
            best = gains.argmax(1)
            for node in np.flatnonzero(gains[np.arange(width), best] > 1e-9).tolist():
                j = int(best[node])
                feature[first + node], threshold[first + node] = j, edges[j][places[node, j]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + ridge)
        score += value[leaf]
        out.append((feature, threshold, value))
    return Trees(depth, base, *(np.stack(v) for v in zip(*out, strict=True)))
