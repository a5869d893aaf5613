"""Small tree ensembles: fitted from a bounded matrix, applied as SQL text that stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Leaf:
    value: float

    def sql(self, names: Sequence[str]) -> str:
        return f"{self.value!r}D"


@dataclass(frozen=True)
class Split:
    feature: int
    at: float
    low: Leaf | Split
    high: Leaf | Split

    def sql(self, names: Sequence[str]) -> str:
        return f"CASE WHEN {names[self.feature]} <= {self.at!r}D THEN {self.low.sql(names)} ELSE {self.high.sql(names)} END"


def edges_of(x: np.ndarray, most: int = 64) -> list[np.ndarray]:
    """Thresholds to try for each feature: middles between neighbouring values, or between quantiles where there are many."""
    out = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > most:
            values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, most)))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], depth: int, least: float, pick, l2: float = 0.0) -> Leaf | Split:
    """The tree whose leaves are sum(g) / (sum(h) + l2), each split the one that raises sum(g)**2 / sum(h) most.

    pick(n): the features that a node may split on. With g = labels and h = 1 leaves are means and
    the gain is the fall in Gini impurity.
    """
    total_g, total_h = g.sum(), h.sum()
    best = (1e-9, -1, 0.0)
    if depth and len(g) >= 2:
        for j in pick(x.shape[1]):
            if not len(edges[j]):
                continue
            bins = np.searchsorted(edges[j], x[:, j], "left")
            gs = np.cumsum(np.bincount(bins, g, len(edges[j]) + 1))[:-1]
            hs = np.cumsum(np.bincount(bins, h, len(edges[j]) + 1))[:-1]
            ns = np.cumsum(np.bincount(bins, minlength=len(edges[j]) + 1))[:-1]
            fair = (ns >= least) & (len(g) - ns >= least)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fair, gs**2 / (hs + l2) + (total_g - gs) ** 2 / (total_h - hs + l2) - total_g**2 / (total_h + l2), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(edges[j][k]))
    if best[1] < 0:
        return Leaf(round(float(total_g / (total_h + l2)) if total_h + l2 > 0 else 0.0, 9))
    low = x[:, best[1]] <= best[2]
    return Split(best[1], best[2], grow(x[low], g[low], h[low], edges, depth - 1, least, pick, l2), grow(x[~low], g[~low], h[~low], edges, depth - 1, least, pick, l2))


@dataclass(frozen=True)
class Ensemble:
    trees: tuple[Leaf | Split, ...]
    base: float
    scale: float
    logistic: bool

    def sql(self, names: Sequence[str]) -> str:
        """The score, 0 to 1, as SQL over these expressions."""
        total = " + ".join(f"({t.sql(names)})" for t in self.trees) or "0D"
        raw = f"({self.base!r}D + {self.scale!r}D * ({total}))"
        return f"(1D / (1D + exp(-{raw})))" if self.logistic else raw


def random_forest(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 6, least: int = 3, seed: int = 3) -> Ensemble:
    """Trees on bootstrap samples, each node choosing among a random half of the features; the score is their mean."""
    rng = np.random.default_rng(seed)
    edges, grown = edges_of(x), []
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        grown.append(grow(x[rows], y[rows].astype(float), np.ones(len(rows)), edges, depth, least, lambda n: rng.choice(n, max(1, n // 2), replace=False)))
    return Ensemble(tuple(grown), 0.0, 1.0 / trees, False)


def apply_tree(tree: Leaf | Split, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, Leaf):
        return np.full(len(x), tree.value)
    return np.where(x[:, tree.feature] <= tree.at, apply_tree(tree.low, x), apply_tree(tree.high, x))


def boosted_trees(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 5) -> Ensemble:
    """Gradient boosting of the log loss with Newton leaves."""
    edges, grown = edges_of(x), []
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    z = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        tree = grow(x, y - p, p * (1 - p), edges, depth, least, range, 1.0)
        grown.append(tree)
        z += rate * apply_tree(tree, x)
    return Ensemble(tuple(grown), base, rate, True)
