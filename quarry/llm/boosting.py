"""Gradient-boosted trees for a yes-or-no label, grown on sums over all rows, wherever the rows are.

Growing asks for one array of whole numbers at each level of a tree: sums of gradients by node, feature and bin, of several models side by
side. How rows are parted and in what order they come is nothing to it: gradients are whole multiples of 1 / GRAIN and margins of 1 / UNIT, so
that sums are exact. Equal rows may be one row with their number.

Defined cases: features are finite numbers, no nulls; ties between splits go to the first feature and bin; margins are held within LIMIT; no
row to rate gives no rate.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

UNIT, GRAIN = 1 << 10, 1 << 20
#: The largest margin, in units.
LIMIT = 16 * UNIT


class Rows:
    """Rows of features, how many rows each one stands for, and marks of the caller; margins are kept as trees come on top."""

    def __init__(self, x: np.ndarray, n: np.ndarray, **marks: np.ndarray):
        self.x, self.n, self.known = x, n, {}
        self.__dict__.update(marks)

    def codes(self, edges: list[np.ndarray]) -> np.ndarray:
        if self.known.get("edges") is not edges:
            self.known = {"edges": edges, "codes": coded(self.x, edges)}
        return self.known["codes"]

    def margin(self, model: BoostedTrees, trees: int | None = None) -> np.ndarray:
        """In units, of the first so many trees."""
        codes, trees = self.codes(model.edges), len(model.trees) if trees is None else trees
        own, done, margin = self.known.get(id(model), (model, 0, np.full(len(self.n), model.base)))
        for tree in model.trees[done:trees]:
            margin = margin + model.leaf(tree, codes)
        self.known[id(model)] = own, trees, margin
        return np.clip(margin, -LIMIT, LIMIT)


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1).astype(np.uint8)


def quantiles(values: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of values that each stand for n, as numpy has them of all of them in a row."""
    order = np.argsort(values, kind="stable")
    values, upto = values[order], np.cumsum(n[order])
    place = np.asarray(at) * (upto[-1] - 1)
    low, high = (values[np.searchsorted(upto, f(place), side="right")] for f in (np.floor, np.ceil))
    return low + (place - np.floor(place)) * (high - low)


def edges_of(values: np.ndarray, n: np.ndarray, bins: int = 16) -> np.ndarray:
    return np.unique(quantiles(values, n, np.linspace(0, 1, bins + 1)[1:-1]))


class BoostedTrees:
    """Logistic loss, histogram splits, trees of one depth; deterministic."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 16, least: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0  # in units, as leaves are
        self.a, self.b = 1.0, 0.0  # calibration

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rows = Rows(x, np.ones(len(x), np.int64), yes=y > 0)
        edges = [edges_of(x[:, j], rows.n, self.bins) for j in range(x.shape[1])]
        grow([self], edges, lambda f: f(rows), lambda rows, _: (np.ones(len(rows.n), bool), rows.yes))
        return self

    def gradients(self, rows: Rows, used: np.ndarray, yes: np.ndarray, level: int) -> np.ndarray:
        """First and second derivatives by node of a level of the last tree, feature and bin."""
        codes, n = rows.codes(self.edges)[used], rows.n[used]
        p = 1 / (1 + np.exp(-rows.margin(self, len(self.trees) - 1)[used] / UNIT))
        both = np.rint((yes[used] - p) * GRAIN) * n, np.rint(p * (1 - p) * GRAIN) * n
        node = self._node(self.trees[-1], codes, level) * self.bins
        out = np.zeros((2, len(self.edges), self.bins << level), np.int64)
        for j in range(len(self.edges)):
            for k in range(2):
                out[k, j] = np.bincount(node + codes[:, j], both[k], self.bins << level)
        return out.reshape(2, len(self.edges), 1 << level, self.bins).swapaxes(1, 2)

    def split(self, sums: np.ndarray, level: int) -> None:
        """Split each node of a level of the last tree where that gains most; the last level's halves are the leaves."""
        feature, cut, value = self.trees[-1]
        left_g, left_h = np.cumsum(sums, axis=3) / GRAIN
        all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
        gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
        gain[(left_h < 1e-3 * self.least) | (all_h - left_h < 1e-3 * self.least)] = 0
        for k in range(1 << level):
            j, at = np.unravel_index(int(gain[k].argmax()), gain[k].shape)
            g, h = all_g[k, 0, 0], all_h[k, 0, 0]
            if gain[k, j, at] > 1e-9:
                feature[(1 << level) - 1 + k], cut[(1 << level) - 1 + k] = j, at
                g, h = left_g[k, j, at], left_h[k, j, at]
            if level == self.depth - 1:
                value[2 * k] = round(self.rate * g / (h + 1) * UNIT)
                value[2 * k + 1] = round(self.rate * (all_g[k, 0, 0] - g) / (all_h[k, 0, 0] - h + 1) * UNIT)

    def _node(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray, level: int) -> np.ndarray:
        """Each row's node among those of a level."""
        feature, cut, _ = tree
        node, rows = np.zeros(len(codes), int), np.arange(len(codes))
        for _ in range(level):
            node = 2 * node + 1 + (codes[rows, feature[node]] > cut[node])
        return node - ((1 << level) - 1)

    def leaf(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray) -> np.ndarray:
        return tree[2][self._node(tree, codes, self.depth)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return Rows(x, np.ones(len(x), np.int64)).margin(self) / UNIT

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Fit a * margin + b on rows held out from training."""
        return self.calibrate_margins(self.margin(x), y, np.ones(len(x)))

    def calibrate_margins(self, m: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 30) -> BoostedTrees:
        """The same by Newton steps on the logistic loss, of margins that each stand for n."""
        w, yes, no = np.array([1.0, 0.0]), (n * y).sum(), (n * (1 - y)).sum()
        target = np.where(y > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(w[0] * m + w[1], -30, 30)))
            r, s = n * (p - target), n * (p * (1 - p) + 1e-9)
            grad = np.array([(r * m).sum() + 1e-3 * (w[0] - 1), r.sum()])
            hess = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-3]])
            move = np.linalg.solve(hess, grad)
            w -= np.clip(move, -1, 1)
            if np.abs(move).max() < 1e-8:
                break
        self.a, self.b = float(w[0]), float(w[1])
        return self

    def rated(self, m: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * m + self.b, -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.rated(self.margin(x))


def grow(models: list[BoostedTrees], edges: list[np.ndarray], total: Callable, marked: Callable) -> None:
    """Fit models of one shape side by side.

    total(f) is the sum of f(rows), an array of whole numbers, over all parts of the rows; marked(rows, i) says which rows model i learns from,
    and which rows are positives.
    """
    every = range(len(models))
    for m in models:
        m.edges, m.trees = edges, []

    def sizes(rows: Rows) -> np.ndarray:
        return np.array([[rows.n[used].sum(), rows.n[used & yes].sum()] for used, yes in (marked(rows, i) for i in every)], np.int64)

    for m, (n, yes) in zip(models, total(sizes)):
        share = min(max(float(yes / max(n, 1)), 1e-3), 1 - 1e-3)
        m.base = round(float(np.log(share / (1 - share))) * UNIT)
    inner = 2 ** models[0].depth - 1
    for _ in range(models[0].rounds):
        for m in models:
            m.trees.append((np.zeros(inner, int), np.full(inner, 1 << 30), np.zeros(inner + 1, np.int64)))
        for level in range(models[0].depth):
            sums = total(lambda rows, level=level: np.stack([models[i].gradients(rows, *marked(rows, i), level) for i in every]))
            for m, s in zip(models, sums):
                m.split(s, level)
