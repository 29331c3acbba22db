"""Gradient-boosted trees for two classes in numpy: histograms of binned features, trees of a fixed depth."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # trees x inner nodes: right if the value is above
    leaf: np.ndarray  # trees x leaves
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.base), np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for f, t, leaf in zip(self.feature, self.limit, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[row, f[at]] > t[at])
            out += leaf[at - (len(leaf) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 16, l2: float = 2.0) -> Boosted:
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)  # value > edges[b - 1]
    place = binned + np.arange(width) * bins
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p0 / (1 - p0)))
    score, inner = np.full(n, base), (1 << depth) - 1
    all_f, all_t, all_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, t, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            flat = ((at - first)[:, None] * (width * bins) + place).ravel()
            sums = [np.bincount(flat, np.repeat(v, width), many * width * bins).reshape(many, width, bins) for v in (g, h)]
            left_g, left_h = (np.cumsum(s, axis=2) for s in sums)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
            gain[:, :, -1] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k, b in enumerate(best):
                j, c = divmod(int(b), bins)
                if gain[k, j, c] > 1e-9 and c < len(edges[j]):
                    f[first + k], t[first + k], cut[first + k] = j, edges[j][c], c
            at = 2 * at + 1 + (binned[np.arange(n), f[at]] > cut[at])
        leaf_of = at - inner
        leaf = rate * np.bincount(leaf_of, g, 1 << depth) / (np.bincount(leaf_of, h, 1 << depth) + l2)
        score += leaf[leaf_of]
        all_f.append(f)
        all_t.append(t)
        all_leaf.append(leaf)
    return Boosted(np.array(all_f), np.array(all_t), np.array(all_leaf), base)
