"""A small decision tree, fitted on the driver from a small labelled table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Arrays of a binary tree; ``feature`` is -1 in a leaf, ``value`` its share of the positive class."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of the positive class for each row of features."""
        at = np.zeros(len(x), np.int32)
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.value[at]
            rows = np.flatnonzero(inner)
            n = at[rows]
            go = x[rows, self.feature[n]] <= self.cut[n]
            at[rows] = np.where(go, self.left[n], self.right[n])


def _gini(pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    p = pos / n
    return n * p * (1 - p)


def fit(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 2) -> Tree:
    """Grow a tree by the decrease of Gini impurity; leaves hold ``least`` rows or more."""
    nodes: list[list] = []

    def grow(rows: np.ndarray, d: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y[rows].mean())])
        if d == 0 or len(rows) < 2 * least or nodes[me][4] in (0.0, 1.0):
            return me
        best = (1e-9, -1, 0.0)
        base = _gini(np.array([y[rows].sum()]), np.array([len(rows)]))[0]
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, p = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order))
            ok = (v[1:] > v[:-1]) & (n >= least) & (len(order) - n >= least)
            if ok.any():
                gain = base - _gini(p[:-1], n) - _gini(p[-1] - p[:-1], len(order) - n)
                gain[~ok] = -1
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], f, (v[i] + v[i + 1]) / 2)
        if best[1] >= 0:
            go = x[rows, best[1]] <= best[2]
            nodes[me][:2] = [best[1], best[2]]
            nodes[me][2] = grow(rows[go], d - 1)
            nodes[me][3] = grow(rows[~go], d - 1)
        return me

    grow(np.arange(len(y)), depth)
    f, c, a, b, v = zip(*nodes)
    return Tree(np.array(f, np.int32), np.array(c), np.array(a, np.int32), np.array(b, np.int32), np.array(v))
