"""Gradient-boosted trees for two classes: histogram splits, logistic loss, numpy."""

from __future__ import annotations

import numpy as np


class Trees:
    """Trees of one depth; feature, threshold per inner node and value per leaf, level by level."""

    def __init__(self, depth: int):
        self.depth, self.trees, self.bias = depth, [], 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[rows, feature[at]] > cut[at])
            out += value[node]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 60, rate: float = 0.2, bins: int = 32,
            ridge: float = 1.0) -> "Trees":
        n, d = x.shape
        marks = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(d)]
        b = np.stack([np.searchsorted(marks[j], x[:, j], "left") for j in range(d)], 1)
        p = np.clip(np.average(y, weights=w), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(p / (1 - p)))
        f = np.full(n, self.bias)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = w * (y - q), w * q * (1 - q)
            feature, cut = np.zeros((1 << self.depth) - 1, np.int64), np.full((1 << self.depth) - 1, np.inf)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                k = 1 << level
                best, where, split = np.full(k, 1e-6), np.zeros(k, np.int64), np.full(k, np.inf)
                place = np.full(k, bins + 1)
                for j in range(d):
                    if not len(marks[j]):
                        continue
                    m = len(marks[j]) + 1
                    gs = np.bincount(node * m + b[:, j], g, k * m).reshape(k, m).cumsum(1)
                    hs = np.bincount(node * m + b[:, j], h, k * m).reshape(k, m).cumsum(1)
                    gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
                    top = gain.argmax(1)
                    value = gain[np.arange(k), top]
                    new = value > best
                    best[new], where[new], split[new], place[new] = value[new], j, marks[j][top[new]], top[new]
                at = slice(k - 1, 2 * k - 1)
                feature[at], cut[at] = where, split
                node = 2 * node + (b[np.arange(n), where[node]] > place[node])
            leaf = 1 << self.depth
            value = rate * np.bincount(node, g, leaf) / (np.bincount(node, h, leaf) + ridge)
            f += value[node]
            self.trees.append((feature, cut, value))
        return self
