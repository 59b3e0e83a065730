"""Gradient-boosted trees on binned features and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Trees:
    """Complete binary trees of one depth: at each inner node, go right if the feature exceeds the threshold."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, leaves)
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner] if len(x) else 0
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, ridge: float = 2.0, least: int = 8) -> Trees:
    """Logistic boosting; splits by gain over quantile bins."""
    n, m = x.shape
    rate_y = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    start = float(np.log(rate_y / (1 - rate_y)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    flat = code + np.arange(m) * bins
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = [], [], []
    margin = np.full(n, start)
    for _ in range(trees):
        p = _sigmoid(margin)
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(node == k)
                if len(rows) >= 2 * least:
                    at = flat[rows].ravel()
                    sums = [np.bincount(at, np.repeat(w[rows], m), m * bins).reshape(m, bins).cumsum(axis=1) for w in (g, h)]
                    count = np.bincount(at, minlength=m * bins).reshape(m, bins).cumsum(axis=1)
                    gl, hl = sums[0][:, :-1], sums[1][:, :-1]
                    gt, ht = sums[0][:, -1:], sums[1][:, -1:]
                    gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                    ok = (count[:, :-1] >= least) & (len(rows) - count[:, :-1] >= least)
                    gain = np.where(ok, gain, -1)
                    j, b = np.unravel_index(gain.argmax(), gain.shape)
                    if gain[j, b] > 1e-6 and b < len(edges[j]):
                        feature[k], threshold[k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[np.minimum(node, inner - 1)]] > threshold[np.minimum(node, inner - 1)])
        leaf = node - inner
        top, bottom = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value = rate * top / (bottom + ridge)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(np.array(features), np.array(thresholds), np.array(values), start)


@dataclass
class Isotonic:
    """A rising piecewise linear map from margins to probabilities."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value)


def isotonic(margin: np.ndarray, y: np.ndarray, prior: float = 1.0) -> Isotonic:
    """Pool adjacent violators; each pool's value is drawn to the overall rate by prior rows, then made rising again by its pools' order."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # weight, sum of y, sum of margins
    for m, v in zip(margin[order], y[order], strict=True):
        pools.append([1.0, float(v), float(m)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            w, s, t = pools.pop()
            pools[-1][0] += w
            pools[-1][1] += s
            pools[-1][2] += t
    mean = float(y.mean())
    value = np.array([(s + prior * mean) / (w + prior) for w, s, _ in pools])
    return Isotonic(np.array([t / w for w, _, t in pools]), np.maximum.accumulate(value))
