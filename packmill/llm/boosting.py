"""Gradient-boosted trees on binned features, small enough to be fitted on the driver."""

import numpy as np


class Boosted:
    """Additive trees of a fixed depth for a binary label, logistic loss, Newton leaf values."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 24, shrink: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.shrink = rounds, depth, rate, bins, shrink

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(column, quantiles)) for column in x.T]
        binned = self._binned(x)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        margin, self.trees = np.full(len(y), self.start), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += self._apply(tree, binned)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, column, "left") for e, column in zip(self.edges, x.T, strict=True)], axis=1)

    def _grow(self, binned, slope, bend):
        """Every level splits all its nodes; a node without a useful split passes all to the left."""
        node = np.zeros(len(binned), np.int64)
        features, cuts = [], []
        for level in range(self.depth):
            count = 1 << level
            feature, cut, best = np.zeros(count, np.int64), np.full(count, self.bins + 1), np.full(count, 1e-6)
            for f in range(binned.shape[1]):
                width = len(self.edges[f]) + 1
                if width < 2:
                    continue
                at = node * width + binned[:, f]
                g, h = (np.bincount(at, v, count * width).reshape(count, width) for v in (slope, bend))
                gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
                gt, ht = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
                gain = (gl ** 2 / (hl + self.shrink) + (gt - gl) ** 2 / (ht - hl + self.shrink) - gt ** 2 / (ht + self.shrink))
                top = gain.argmax(axis=1)
                value = gain[np.arange(count), top]
                better = value > best
                feature[better], cut[better], best[better] = f, top[better], value[better]
            features.append(feature)
            cuts.append(cut)
            node = node * 2 + (binned[np.arange(len(binned)), feature[node]] > cut[node])
        leaves = 1 << self.depth
        g, h = (np.bincount(node, v, leaves) for v in (slope, bend))
        return features, cuts, -self.rate * g / (h + self.shrink)

    def _apply(self, tree, binned):
        features, cuts, values = tree
        node = np.zeros(len(binned), np.int64)
        for feature, cut in zip(features, cuts, strict=True):
            node = node * 2 + (binned[np.arange(len(binned)), feature[node]] > cut[node])
        return values[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        return self.start + sum((self._apply(t, binned) for t in self.trees), np.zeros(len(x)))


def calibrated(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits labels to margins (Newton steps)."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        g = np.array([((p - y) * margin).sum() + 1e-3 * (a - 1), (p - y).sum() + 1e-3 * b])
        w = p * (1 - p)
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return float(a), float(b)


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability from which at least `precision` of the labels are positive; above 1 if none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)  # equal scores stay together
    good = np.flatnonzero((right >= precision) & last)
    return float(p[order][good[-1]]) if len(good) else 2.0
