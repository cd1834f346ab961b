"""Gradient-boosted regression trees for small tables, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A complete binary tree; node k has the children 2k+1 and 2k+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            f = self.feature[at]
            right = x[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(x)]


def _split(x: np.ndarray, r: np.ndarray, rows: np.ndarray, least: int) -> tuple[int, float] | None:
    """The feature and the cut that lower the squared error most."""
    n = len(rows)
    if n < 2 * least:
        return None
    order = np.argsort(x[rows], axis=0, kind="stable")
    xs = np.take_along_axis(x[rows], order, axis=0)
    left = np.cumsum(r[rows][order], axis=0)
    total = left[-1]
    k = np.arange(1, n)[:, None]
    gain = left[:-1] ** 2 / k + (total - left[:-1]) ** 2 / (n - k)
    gain[xs[:-1] == xs[1:]] = -np.inf
    gain[: least - 1], gain[n - least :] = -np.inf, -np.inf
    i, f = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[i, f] <= total[f] ** 2 / n + 1e-12:
        return None
    return int(f), float((xs[i, f] + xs[i + 1, f]) / 2)


def grow(x: np.ndarray, r: np.ndarray, rows: np.ndarray, depth: int, least: int, columns: np.ndarray) -> Tree:
    size = 2 ** (depth + 1) - 1
    t = Tree(np.full(size, -1), np.zeros(size), np.zeros(size), depth)
    todo = [(0, rows)]
    while todo:
        at, own = todo.pop()
        t.value[at] = r[own].mean() if len(own) else 0.0
        found = _split(x[:, columns], r, own, least) if 2 * at + 2 < size else None
        if found:
            t.feature[at], t.cut[at] = columns[found[0]], found[1]
            right = x[own, t.feature[at]] > found[1]
            todo += [(2 * at + 1, own[~right]), (2 * at + 2, own[right])]
    return t


@dataclass
class Boosted:
    start: float
    rate: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 240, depth: int = 3, rate: float = 0.1, least: int = 4, share: float = 0.7, width: float = 0.35, seed: int = 0) -> Boosted:
    """Squared-error boosting; every tree sees a share of the rows and of the columns."""
    rng = np.random.default_rng(seed)
    model = Boosted(float(y.mean()), rate, [])
    score = np.full(len(y), model.start)
    for _ in range(trees):
        rows = np.sort(rng.permutation(len(y))[: max(2 * least, int(share * len(y)))])
        columns = np.sort(rng.permutation(x.shape[1])[: max(1, int(np.ceil(width * x.shape[1])))])
        t = grow(x, y - score, rows, depth, least, columns)
        score += rate * t.predict(x)
        model.trees.append(t)
    return model
