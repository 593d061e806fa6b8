"""Gradient-boosted trees for a yes-no label over dense features, and isotonic calibration; numpy only."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Shallow trees fitted to the gradient of the logistic loss, on binned features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: int = 5) -> None:
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least
        self.base, self.nodes = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rate = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(rate / (1 - rate)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        # bins of zeros must not hide the rare values beside them
        edges = [np.unique(np.r_[e, np.quantile(c[c > 0], (0.0, 0.25, 0.5, 0.75)) - 1e-12]) if (c > 0).any() else e for e, c in zip(edges, x.T, strict=True)]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        width = max((len(e) for e in edges), default=0) + 1
        f = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            feature, cut, value, at = {}, {}, {}, np.ones(len(y), np.int64)
            for node in range(1, 2**self.depth):
                rows = np.flatnonzero(at == node)
                if len(rows) < 2 * self.least:
                    continue
                best = (1e-6, -1, 0)
                whole = g[rows].sum() ** 2 / (h[rows].sum() + self.ridge)
                for j in range(x.shape[1]):
                    b = binned[rows, j]
                    gs, hs, ns = (np.cumsum(np.bincount(b, w, width)) for w in (g[rows], h[rows], np.ones(len(rows))))
                    gain = gs**2 / (hs + self.ridge) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + self.ridge) - whole
                    gain[(ns < self.least) | (ns[-1] - ns < self.least)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
                if best[1] >= 0:
                    feature[node], cut[node] = best[1], float(edges[best[1]][best[2]])
                    at[rows] = 2 * node + (x[rows, best[1]] > cut[node])
            for node in np.unique(at).tolist():
                rows = at == node
                value[node] = self.rate * float(g[rows].sum() / (h[rows].sum() + self.ridge))
                f[rows] += value[node]
            self.nodes.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for feature, cut, value in self.nodes:
            at = np.ones(len(x), np.int64)
            for node in sorted(feature):
                rows = np.flatnonzero(at == node)
                at[rows] = 2 * node + (x[rows, feature[node]] > cut[node])
            out = np.zeros(max(2 ** (self.depth + 1), 2))
            for node, v in value.items():
                out[node] = v
            f += out[at]
        return f

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


class Isotonic:
    """Non-decreasing map from scores to label rates, by pooling adjacent violators; linear between its steps."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # mean, weight, sum of scores
        for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([v, 1.0, s])
            while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
                m, w, t = blocks.pop()
                blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + m * w) / (blocks[-1][1] + w), blocks[-1][1] + w, blocks[-1][2] + t]
        self.x = np.array([t / w for _, w, t in blocks]) if blocks else np.array([0.0, 1.0])
        self.y = np.array([m for m, _, _ in blocks]) if blocks else np.array([0.0, 1.0])
        return self

    def predict(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)
