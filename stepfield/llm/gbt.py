"""Histogram gradient-boosted trees for binary labels, kept as flat arrays.

Features are binned at quantiles; each tree is grown level by level to a fixed depth from per-bin sums of gradients and
hessians, as a complete binary tree, so a forest is three arrays and traversal is a few gathers over (rows, trees).
Training runs on the driver over a sample whose bound the caller documents; it is deterministic in the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """feature and cut: (trees, 2^depth - 1); leaf: (trees, 2^depth). A row goes right where its feature exceeds the cut."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        x = np.asarray(x, np.float64)
        trees, depth = len(self.leaf), int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.cut[tree, node])
        score = self.base + self.leaf[tree, node - (2**depth - 1)].sum(1) if trees else np.full(len(x), self.base)
        return 1 / (1 + np.exp(-score))


def train(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Forest:
    """A forest for labels y in {0, 1}. With no rows it says 0.5, with one class only the smoothed prior."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(prior / (1 - prior)))
    nodes, leaves = 2**depth - 1, 2**depth
    if len(y) == 0 or y.min() == y.max():
        return Forest(base, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)])
    features = len(binned)
    score, forest = np.full(len(y), base), ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        feature, cut, node = np.zeros(nodes, np.int64), np.full(nodes, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            here = node - first
            best, chosen_f, chosen_b = np.full(width, 1e-6), np.zeros(width, np.int64), np.full(width, bins)
            for f in range(features):
                key = here * bins + binned[f]
                gs = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain[:, len(cuts[f]) :] = 0
                b = gain.argmax(1)
                won = gain[np.arange(width), b] > best
                best[won], chosen_f[won], chosen_b[won] = gain[np.arange(width), b][won], f, b[won]
            for k in range(width):
                feature[first + k] = chosen_f[k]
                if chosen_b[k] < bins:
                    cut[first + k] = cuts[chosen_f[k]][chosen_b[k]]
            node = 2 * node + 1 + (binned[chosen_f[here], np.arange(len(y))] > chosen_b[here])
        here = node - nodes
        leaf = -rate * np.bincount(here, g, leaves) / (np.bincount(here, h, leaves) + l2)
        score += leaf[here]
        for kept, made in zip(forest, (feature, cut, leaf), strict=True):
            kept.append(made)
    return Forest(base, *(np.stack(a) for a in forest))
