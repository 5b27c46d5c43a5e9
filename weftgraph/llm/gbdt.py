"""Histogram gradient boosting for binary labels, stored as flat arrays.

All trees have one depth and lie in complete-binary-tree order in shared arrays, so
scoring walks every row of a batch down a tree with `depth` numpy gathers. The same arrays
can be written as SQL CASE expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """feature and threshold: [trees, 2**depth - 1]; leaf: [trees, 2**depth]; go right where value > threshold."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.float64)
        depth = self.leaf.shape[1].bit_length() - 1
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (len(leaf) - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))

    def sql_margin(self, names: list[str]) -> str:
        """The margin as a SQL expression over the named features: the same doubles, added in the same order."""

        def number(v: float) -> str:
            return f"{float(v)!r}D"

        def walk(t: int, node: int) -> str:
            inner = self.feature.shape[1]
            if node >= inner:
                return number(self.leaf[t, node - inner])
            left, right = walk(t, 2 * node + 1), walk(t, 2 * node + 2)
            if left == right or not np.isfinite(self.threshold[t, node]):
                return left
            return f"CASE WHEN {names[self.feature[t, node]]} > {number(self.threshold[t, node])} THEN {right} ELSE {left} END"

        return " + ".join([number(self.base), *(f"({walk(t, 0)})" for t in range(len(self.feature)))])


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, weight: np.ndarray | None = None
) -> Trees:
    """Boost `trees` trees on quantile-binned columns with the logistic loss.

    An empty sample or one class alone gives a model of the (smoothed) base rate.
    """
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    w = np.ones(len(y)) if weight is None else np.asarray(weight, dtype=np.float64)
    p = (np.sum(w * y) + 0.5) / (np.sum(w) + 1)
    base = float(np.log(p / (1 - p)))
    inner = 2**depth - 1
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    if not len(y) or len(np.unique(y)) < 2:
        return Trees(base, feature[:0], threshold[:0], leaf[:0])
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T, strict=True)], axis=1)
    width = bins + 1
    flat = binned + np.arange(x.shape[1]) * width  # one histogram row for each feature
    margin = np.full(len(y), base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = w * (prob - y), w * np.maximum(prob * (1 - prob), 1e-9)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            size = x.shape[1] * width
            key = ((node - first)[:, None] * size + flat).ravel()
            hist = [np.bincount(key, np.repeat(v, x.shape[1]), count * size).reshape(count, x.shape[1], width) for v in (g, h)]
            gl, hl = (np.cumsum(v, axis=2) for v in hist)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            for f, e in enumerate(edges):
                gain[:, f, len(e) :] = -np.inf  # no cut there
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), width)
                if gain[k, f, b] > 1e-9:
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        at = node - inner
        sums = [np.bincount(at, v, inner + 1) for v in (g, h)]
        leaf[t] = -rate * sums[0] / (sums[1] + l2)
        margin += leaf[t][at]
    return Trees(base, feature, threshold, leaf)
