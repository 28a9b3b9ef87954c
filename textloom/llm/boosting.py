"""Gradient-boosted trees of depth two on a bounded sample, scored as one SQL expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Split:
    feature: int
    threshold: float
    low: "Split | float"  # for values <= threshold
    high: "Split | float"


def _leaf(gradient: np.ndarray, hessian: np.ndarray, smooth: float) -> float:
    return float(gradient.sum() / (hessian.sum() + smooth))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, smooth: float) -> Split | float:
    if depth == 0 or len(g) < 8:
        return _leaf(g, h, smooth)
    best, at = g.sum() ** 2 / (h.sum() + smooth) + 1e-6, None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values[:-1][:64], values[1:][:64]):
            low = x[:, f] <= (a + b) / 2
            gain = g[low].sum() ** 2 / (h[low].sum() + smooth) + g[~low].sum() ** 2 / (h[~low].sum() + smooth)
            if gain > best:
                best, at = gain, (f, float((a + b) / 2), low)
    if at is None:
        return _leaf(g, h, smooth)
    f, t, low = at
    return Split(
        f, t, _grow(x[low], g[low], h[low], depth - 1, smooth), _grow(x[~low], g[~low], h[~low], depth - 1, smooth)
    )


def _apply(tree: Split | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, Split):
        return np.full(len(x), tree)
    return np.where(x[:, tree.feature] <= tree.threshold, _apply(tree.low, x), _apply(tree.high, x))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, rate: float = 0.4, depth: int = 2) -> list[Split | float]:
    """Trees for the log odds of y = 1; the first entry is the prior."""
    prior = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    trees: list[Split | float] = [prior]
    score = np.full(len(y), prior)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, rate * (y - p), p * (1 - p), depth, 1.0)
        trees.append(tree)
        score += _apply(tree, x)
    return trees


def predict(trees: list[Split | float], x: np.ndarray) -> np.ndarray:
    return sum((_apply(t, x) for t in trees), np.zeros(len(x)))


def expression(trees: list[Split | float], feature: Callable[[int], Column]) -> Column:
    """The summed score of the trees as a column expression."""

    def of(tree: Split | float) -> Column:
        if not isinstance(tree, Split):
            return F.lit(float(tree))
        return F.when(feature(tree.feature) <= F.lit(tree.threshold), of(tree.low)).otherwise(of(tree.high))

    total = of(trees[0])
    for tree in trees[1:]:
        total = total + of(tree)
    return total
