"""Gradient-boosted trees on binned features, for models that are fitted on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Complete binary trees: node ``k`` of a level asks whether ``bin[feature] > cut`` and leads to ``2k + 1`` or ``2k``."""

    edges: list[np.ndarray]
    features: np.ndarray    # tree, level, node
    cuts: np.ndarray
    leaves: np.ndarray      # tree, leaf
    base: float

    @staticmethod
    def _bins(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint8)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 32,
            rate: float = 0.2, ridge: float = 2.0) -> BoostedTrees:
        edges = []
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            edges.append(values[:-1] if len(values) <= bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])))
        b = cls._bins(edges, x).astype(np.int64)
        n, m = b.shape
        mean = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)) if n else 0.5
        base = float(np.log(mean / (1 - mean)))
        total = np.full(n, base)
        features, cuts = np.zeros((trees, depth, 1 << depth), np.int64), np.zeros((trees, depth, 1 << depth), np.int64)
        leaves = np.zeros((trees, 1 << depth))
        for t in range(trees):
            p = 1 / (1 + np.exp(-total))
            g, h = weight * (y - p), weight * p * (1 - p)
            node = np.zeros(n, dtype=np.int64)
            for level in range(depth):
                width = 1 << level
                best = np.full(width, -np.inf)
                for j in range(m):
                    at = node * (bins + 1) + b[:, j]
                    gs, hs = (np.bincount(at, v, width * (bins + 1)).reshape(width, -1).cumsum(1) for v in (g, h))
                    gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    gain = gl ** 2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga ** 2 / (ha + ridge)
                    cut = gain.argmax(axis=1)
                    top = gain[np.arange(width), cut]
                    better = top > best + 1e-12
                    best[better] = top[better]
                    features[t, level, :width][better], cuts[t, level, :width][better] = j, cut[better]
                node = 2 * node + (b[np.arange(n), features[t, level, node]] > cuts[t, level, node])
            gs, hs = (np.bincount(node, v, 1 << depth) for v in (g, h))
            leaves[t] = rate * gs / (hs + ridge)
            total += leaves[t, node]
        return cls(edges, features, cuts, leaves, base)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._bins(self.edges, x)
        total = np.full(len(b), self.base)
        rows = np.arange(len(b))
        for t in range(len(self.leaves)):
            node = np.zeros(len(b), dtype=np.int64)
            for level in range(self.features.shape[1]):
                node = 2 * node + (b[rows, self.features[t, level, node]] > self.cuts[t, level, node])
            total += self.leaves[t, node]
        return 1 / (1 + np.exp(-total))
