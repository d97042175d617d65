"""Gradient-boosted trees for binary labels, trained in numpy and written as one SQL expression."""

from __future__ import annotations

import numpy as np


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> tuple:
    """A tree: (feature, cut, left, right), left where the feature is below the cut; or (value,)."""
    value = float(-grad.sum() / (hess.sum() + 1.0))
    if depth == 0 or len(x) < 2 * least:
        return (value,)
    base, best = grad.sum() ** 2 / (hess.sum() + 1.0), (1e-6, -1, 0.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, g, h = x[order, j], np.cumsum(grad[order]), np.cumsum(hess[order])
        at = np.flatnonzero(v[1:] != v[:-1])
        at = at[(at + 1 >= least) & (at + 1 <= len(v) - least)]
        if len(at):
            gain = g[at] ** 2 / (h[at] + 1) + (g[-1] - g[at]) ** 2 / (h[-1] - h[at] + 1) - base
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), j, float(v[at[k]] + v[at[k] + 1]) / 2)
    if best[1] < 0:
        return (value,)
    left = x[:, best[1]] < best[2]
    return best[1], best[2], _grow(x[left], grad[left], hess[left], depth - 1, least), _grow(x[~left], grad[~left], hess[~left], depth - 1, least)


def _apply(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] < tree[1], _apply(tree[2], x), _apply(tree[3], x))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 8) -> list[tuple]:
    total, out = np.zeros(len(x)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        tree = _grow(x, p - y, p * (1 - p), depth, least)
        out.append(_scaled(tree, rate))
        total += _apply(out[-1], x)
    return out


def _scaled(tree: tuple, rate: float) -> tuple:
    return (round(tree[0] * rate, 6),) if len(tree) == 1 else (tree[0], tree[1], _scaled(tree[2], rate), _scaled(tree[3], rate))


def logit(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    return sum((_apply(t, x) for t in trees), np.zeros(len(x)))


def sql(trees: list[tuple], names: list[str]) -> str:
    """The logit as SQL over the named features."""

    def one(tree: tuple) -> str:
        return f"{tree[0]:.6f}D" if len(tree) == 1 else f"if({names[tree[0]]} < {tree[1]:.3f}D, {one(tree[2])}, {one(tree[3])})"

    return " + ".join(one(t) for t in trees)
