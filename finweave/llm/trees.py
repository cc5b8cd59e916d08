"""Small regression trees and gradient boosting on a bounded sample, in numpy on the driver.

Features are cut into at most ``BINS`` quantile bins once; a split is found from the sums of
gradients and curvatures by bin.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Node:
    """A leaf, or a split that sends ``x[feature] <= threshold`` to the left."""

    value: float
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None

    @property
    def is_leaf(self) -> bool:
        return self.feature < 0


@dataclass
class Cuts:
    """Thresholds by feature and the binned sample."""

    edges: list[np.ndarray]
    binned: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Cuts:
        edges, binned = [], np.zeros(x.shape, np.uint8)
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            if len(values) > BINS:
                values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS), method="nearest"))
            middle = (values[1:] + values[:-1]) / 2
            edges.append(middle)
            binned[:, j] = np.searchsorted(middle, x[:, j], "left")
        return cls(edges, binned)


def fit_tree(cuts: Cuts, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, min_rows: int, penalty: float = 1.0, features: np.ndarray | None = None) -> Node:
    """Second-order tree: leaves hold ``sum(g) / (sum(h) + penalty)``."""
    total_g, total_h = g[rows].sum(), h[rows].sum()
    node = Node(float(total_g / (total_h + penalty)))
    if depth == 0 or len(rows) < 2 * min_rows:
        return node
    best = (1e-9, -1, -1)
    for j in range(len(cuts.edges)) if features is None else features:
        n_bins = len(cuts.edges[j]) + 1
        if n_bins < 2:
            continue
        b = cuts.binned[rows, j]
        count = np.cumsum(np.bincount(b, minlength=n_bins))[:-1]
        left_g = np.cumsum(np.bincount(b, weights=g[rows], minlength=n_bins))[:-1]
        left_h = np.cumsum(np.bincount(b, weights=h[rows], minlength=n_bins))[:-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - total_g**2 / (total_h + penalty)
        gain[(count < min_rows) | (len(rows) - count < min_rows)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), int(j), k)
    _, j, k = best
    if j < 0:
        return node
    goes_left = cuts.binned[rows, j] <= k
    node.feature, node.threshold = j, float(cuts.edges[j][k])
    node.left = fit_tree(cuts, g, h, rows[goes_left], depth - 1, min_rows, penalty, features)
    node.right = fit_tree(cuts, g, h, rows[~goes_left], depth - 1, min_rows, penalty, features)
    return node


def tree_values(node: Node, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), node.value)
    if not node.is_leaf:
        left = x[:, node.feature] <= node.threshold
        out[left] = tree_values(node.left, x[left])
        out[~left] = tree_values(node.right, x[~left])
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Boosted:
    """Boosted trees for the log-odds of label 1."""

    prior: float
    rate: float
    trees: list[Node] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.prior)
        for t in self.trees:
            out += self.rate * tree_values(t, x)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.log_odds(x))


def boost(x: np.ndarray, y: np.ndarray, n_trees: int, depth: int, rate: float = 0.3, min_rows: int = 10, part: float = 0.7, seed: int = 1) -> Boosted:
    """Gradient boosting on random parts of the rows."""
    share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(share / (1 - share))), rate)
    if len(np.unique(y)) < 2:
        return model
    rng, cuts = np.random.default_rng(seed), Cuts.of(x)
    z = np.full(len(y), model.prior)
    for _ in range(n_trees):
        p = sigmoid(z)
        rows = np.flatnonzero(rng.random(len(y)) < part)
        tree = fit_tree(cuts, y - p, p * (1 - p), rows, depth, min_rows)
        z += rate * tree_values(tree, x)
        model.trees.append(tree)
    return model
