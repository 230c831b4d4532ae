"""Gradient-boosted trees for a few classes, in numpy.

Features are binned by the training data's quantiles; every round fits one
tree per class to the gradient of the soft-max loss, level by level, with
second-order leaf values.  Deterministic.
"""

from __future__ import annotations

import numpy as np


class Boosted:
    def __init__(self, classes: int, rounds: int = 24, depth: int = 4, rate: float = 0.3, bins: int = 32, smooth: float = 1.0):
        self.classes, self.rounds, self.depth, self.rate = classes, rounds, depth, rate
        self.bins, self.smooth = bins, smooth
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []     # feature, bin, leaf values

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins)[1:-1])) for f in range(x.shape[1])]
        b = self._binned(x)
        logits = np.zeros((len(x), self.classes))
        for _ in range(self.rounds):
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for k in range(self.classes):
                g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])
                tree = self._tree(b, g, h)
                self.trees.append(tree)
                logits[:, k] += self._apply(tree, b)
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        n, features = b.shape
        feature = np.zeros(2 ** self.depth - 1, np.int32)
        split = np.full(2 ** self.depth - 1, 255, np.int32)            # 255: everything goes left
        node = np.zeros(n, np.int64)
        for level in range(self.depth):
            width, base = 2 ** level, 2 ** level - 1
            gain = np.zeros((width, features, self.bins))
            for f in range(features):
                at = (node - base) * self.bins + b[:, f]
                sg = np.bincount(at, g, width * self.bins).reshape(width, self.bins)
                sh = np.bincount(at, h, width * self.bins).reshape(width, self.bins)
                lg, lh = sg.cumsum(1), sh.cumsum(1)
                tg, th = lg[:, -1:], lh[:, -1:]
                score = lg ** 2 / (lh + self.smooth) + (tg - lg) ** 2 / (th - lh + self.smooth) - tg ** 2 / (th + self.smooth)
                gain[:, f] = np.where((lh > 1) & (th - lh > 1), score, 0)
            best = gain.reshape(width, -1).argmax(1)
            good = gain.reshape(width, -1).max(1) > 1e-6
            feature[base:base + width] = best // self.bins
            split[base:base + width] = np.where(good, best % self.bins, 255)
            right = b[np.arange(n), feature[node]] > split[node]
            node = 2 * node + 1 + right
        leaf = node - (2 ** self.depth - 1)
        sg, sh = np.bincount(leaf, g, 2 ** self.depth), np.bincount(leaf, h, 2 ** self.depth)
        return feature, split, -self.rate * sg / (sh + self.smooth)

    def _apply(self, tree, b: np.ndarray) -> np.ndarray:
        feature, split, value = tree
        node = np.zeros(len(b), np.int64)
        rows = np.arange(len(b))
        for _ in range(self.depth):
            node = 2 * node + 1 + (b[rows, feature[node]] > split[node])
        return value[node - (2 ** self.depth - 1)]

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        logits = np.zeros((len(x), self.classes))
        for i, tree in enumerate(self.trees):
            logits[:, i % self.classes] += self._apply(tree, b)
        logits -= logits.max(1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(1, keepdims=True))
