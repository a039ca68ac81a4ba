"""Gradient-boosted trees for two classes, grown on a bounded sample and scored as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Forest:
    """All trees in flat node arrays; a leaf leads to itself, so scoring needs no case for it."""

    base: float
    depth: int
    roots: list[int] = field(default_factory=list)
    feature: np.ndarray | list[int] = field(default_factory=list)
    threshold: np.ndarray | list[float] = field(default_factory=list)
    left: np.ndarray | list[int] = field(default_factory=list)
    right: np.ndarray | list[int] = field(default_factory=list)
    value: np.ndarray | list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        node = len(self.value)
        self.feature.append(0)
        self.threshold.append(0.0)
        self.left.append(node)
        self.right.append(node)
        self.value.append(value)
        return node

    def close(self) -> Forest:
        for name in ("feature", "threshold", "left", "right", "value"):
            setattr(self, name, np.asarray(getattr(self, name)))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1 for the rows of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                low = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def grow(
    x: np.ndarray,
    y: np.ndarray,
    monotone: dict[int, int],
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 32,
    least_rows: int = 20,
    ridge: float = 1.0,
) -> Forest:
    """Trees of logistic loss; ``monotone`` maps a feature to +1 (score may only rise) or -1.

    A split on such a feature is taken only if its sides are in order, and what lies below each side
    is kept on its side of their middle, so the whole score is monotone. Without rows, or with one
    class only, the score is a constant.
    """
    n, wide = x.shape
    share = (y.sum() + 1) / (n + 2)
    forest = Forest(base=float(np.log(share / (1 - share))), depth=depth)
    if n < 2 * least_rows or y.min() == y.max():
        forest.roots.append(forest.add(0.0))
        return forest.close()
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(wide)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f]) for f in range(wide)], axis=1)
    total = np.full(n, forest.base)

    def leaf_value(g: np.ndarray | float, h: np.ndarray | float, low: float, high: float) -> np.ndarray:
        return np.clip(-g / (h + ridge), low, high)

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):  # noqa: ANN202
        best, gs, hs = None, g[rows].sum(), h[rows].sum()
        for f in range(wide):
            k = len(cuts[f])
            b = binned[rows, f]
            counts = np.bincount(b, minlength=k + 1).cumsum()[:k]
            gl = np.bincount(b, g[rows], minlength=k + 1).cumsum()[:k]
            hl = np.bincount(b, h[rows], minlength=k + 1).cumsum()[:k]
            fine = (counts >= least_rows) & (len(rows) - counts >= least_rows)
            vl, vr = leaf_value(gl, hl, low, high), leaf_value(gs - gl, hs - hl, low, high)
            if f in monotone:
                fine &= (vr - vl) * monotone[f] >= 0
            if not fine.any():
                continue
            # what the loss falls by, to second order, with these two values
            gain = -(gl * vl + (hl + ridge) * vl**2 / 2) - ((gs - gl) * vr + (hs - hl + ridge) * vr**2 / 2)
            at = int(np.argmax(np.where(fine, gain, -np.inf)))
            if best is None or gain[at] > best[0] + 1e-12:
                best = (gain[at], f, at, float(vl[at]), float(vr[at]))
        whole = float(leaf_value(gs, hs, low, high))
        return best if best and best[0] > -(gs * whole + (hs + ridge) * whole**2 / 2) + 1e-9 else None

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, left: int) -> int:
        node = forest.add(float(leaf_value(g[rows].sum(), h[rows].sum(), low, high)) * rate)
        found = split(rows, g, h, low, high) if left else None
        if found is None:
            total[rows] += forest.value[node]
            return node
        _, f, at, vl, vr = found
        sides = [(low, high), (low, high)]
        if f in monotone:
            middle = (vl + vr) / 2
            sides = [(low, middle), (middle, high)][:: monotone[f]]
        go = binned[rows, f] <= at
        forest.feature[node], forest.threshold[node] = f, float(cuts[f][at])
        forest.left[node] = build(rows[go], g, h, *sides[0], left - 1)
        forest.right[node] = build(rows[~go], g, h, *sides[1], left - 1)
        return node

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        forest.roots.append(build(np.arange(n), p - y, p * (1 - p), -np.inf, np.inf, depth))
    return forest.close()
