"""Outlier models in numpy for one series, and one that is a Spark aggregate."""

from __future__ import annotations

import numpy as np


class LocalDensity:
    """Local outlier factor: -1 where the neighbours are much denser than the point."""

    def __init__(self, n_neighbors: int = 20, share: float | None = None, bound: float = 1.5):
        self.n_neighbors, self.share, self.bound = n_neighbors, share, bound

    def fit_predict(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        k = min(self.n_neighbors, n - 1)
        if k < 1:
            return np.ones(n, int)
        far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        np.fill_diagonal(far, np.inf)
        near = np.argsort(far, 1, kind="stable")[:, :k]
        dist = np.take_along_axis(far, near, 1)
        reach = np.maximum(dist, dist[near, -1])
        density = 1 / (reach.mean(1) + 1e-10)
        factor = density[near].mean(1) / density
        bound = self.bound if self.share is None else np.quantile(factor, 1 - self.share)
        return np.where(factor > bound, -1, 1)


class Isolation:
    """Isolation forest: -1 where random splits separate a point early."""

    def __init__(self, trees: int = 100, sample: int = 256, share: float | None = None, bound: float = 0.6, seed: int = 0):
        self.trees, self.sample, self.share, self.bound, self.seed = trees, sample, share, bound, seed

    @staticmethod
    def _mean_path(n: float) -> float:
        return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def _build(self, x, rng, depth):
        spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
        if depth == 0 or not len(spread):
            return self._mean_path(len(x))
        f = rng.choice(spread)
        cut = rng.uniform(x[:, f].min(), x[:, f].max())
        low = x[:, f] <= cut
        return f, cut, self._build(x[low], rng, depth - 1), self._build(x[~low], rng, depth - 1)

    def _depths(self, node, x, rows, depth, out):
        if not isinstance(node, tuple):
            out[rows] += depth + node
        elif len(rows):
            low = x[rows, node[0]] <= node[1]
            self._depths(node[2], x, rows[low], depth + 1, out)
            self._depths(node[3], x, rows[~low], depth + 1, out)

    def fit(self, x: np.ndarray):
        rng = np.random.default_rng(self.seed)
        size = min(self.sample, len(x))
        limit = max(1, int(np.ceil(np.log2(max(size, 2)))))
        self.scale = max(self._mean_path(size), 1e-9)
        self.roots = [self._build(x[rng.choice(len(x), size, replace=False)], rng, limit) for _ in range(self.trees)]
        self.cut = self.bound if self.share is None else np.quantile(self.score(x), 1 - self.share)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for root in self.roots:
            self._depths(root, x, np.arange(len(x)), 0, out)
        return 2 ** (-out / len(self.roots) / self.scale)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.where(self.score(x) > self.cut, -1, 1)


class Mahalanobis:
    """Distance from the mean in units of the covariance; evaluated as columns."""

    def __init__(self, bound: float = 3.0):
        self.bound = bound
