"""Gradient-boosted trees of depth two over a small table of weighted, whole-numbered rows.

The table has one row per distinct vector of binned features, whatever the size of
the corpus behind it; the fitted trees become a SQL expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Split on ``feature <= cut``, then each side once more; a side may have no second split."""

    feature: int
    cut: int
    sides: tuple[tuple[int, int, float, float], tuple[int, int, float, float]]

    def value(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for right, (f, cut, low, high) in enumerate(self.sides):
            rows = (x[:, self.feature] > self.cut) == bool(right)
            out[rows] = np.where(x[rows, f] <= cut, low, high)
        return out

    def sql(self, names: Sequence[str]) -> str:
        low, high = (f"CASE WHEN {names[f]} <= {cut} THEN {a:.9f}D ELSE {b:.9f}D END" for f, cut, a, b in self.sides)
        return f"CASE WHEN {names[self.feature]} <= {self.cut} THEN {low} ELSE {high} END"


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[int, int, float, float, float]:
    """(feature, cut, value below, value above, gain) of the best split by second-order gain."""
    whole = -g.sum() / (h.sum() + ridge) if len(g) else 0.0
    best = (0, 1 << 30, whole, whole, 0.0)
    base = g.sum() ** 2 / (h.sum() + ridge) if len(g) else 0.0
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= cut
            gl, hl, gr, hr = g[low].sum(), h[low].sum(), g[~low].sum(), h[~low].sum()
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - base
            if gain > best[4] + 1e-12:
                best = (f, int(cut), -gl / (hl + ridge), -gr / (hr + ridge), gain)
    return best


def boost(
    x: np.ndarray, positive: np.ndarray, negative: np.ndarray, rounds: int = 24, rate: float = 0.4, ridge: float = 1.0
) -> list[Tree]:
    """Trees whose summed values are the log odds of the positive class."""
    total, trees = np.zeros(len(x)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = (positive + negative) * p - positive, (positive + negative) * p * (1 - p)
        f, cut, *_ = _best_split(x, g, h, ridge)
        sides = []
        for right in (False, True):
            rows = (x[:, f] > cut) == right
            f2, cut2, low, high, _ = _best_split(x[rows], g[rows], h[rows], ridge)
            sides.append((f2, cut2, rate * low, rate * high))
        trees.append(Tree(f, cut, (sides[0], sides[1])))
        total += trees[-1].value(x)
    return trees


def calibrated_cut(score: np.ndarray, positive: np.ndarray, negative: np.ndarray, precision: float, margin: float = 0.0) -> float:
    """The score from which on held-out precision reaches ``precision``; infinite if none does.

    With a ``margin`` of so many standard errors the lower end of the precision's interval (Wilson's) must reach
    it, so that a few held-out rows prove nothing. The score lies half way between the least held-out one that
    is accepted and the next lower one, as nothing between them speaks for either.
    """
    order = np.argsort(-score, kind="stable")
    s, good, bad = score[order], np.cumsum(positive[order]), np.cumsum(negative[order])
    last = np.append(np.diff(s) != 0, True) if len(s) else np.zeros(0, bool)
    n, z = np.maximum(good + bad, 1), margin * margin
    share = good / n
    least_share = (share + z / (2 * n) - margin * np.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)
    ok = last & (good >= 1) & (least_share >= precision - 1e-12)
    if not ok.any():
        return float("inf")
    least = s[ok].min()
    below = s[s < least]
    return float((least + below.max()) / 2 if len(below) else least)
