"""Gradient-boosted trees for small bounded samples, usable in numpy and as a Spark expression.

Fitting sees a matrix on the driver whose row bound is a parameter of each operator. Scoring runs
where the data are: vectorised inside a kernel, or as nested CASE expressions in the JVM.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 32


@dataclass
class Tree:
    """Nodes in arrays: ``x[feature] <= cut`` goes to ``low``, else to ``high``; leaves have feature -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for name, v in (("feature", -1), ("cut", 0.0), ("low", -1), ("high", -1), ("value", value)):
            getattr(self, name).append(v)
        return len(self.value) - 1


@dataclass
class Forest:
    """``base`` plus the leaves of all trees is the log-odds; ``slope`` and ``shift`` calibrate it."""

    base: float
    trees: list[Tree]
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for t in self.trees:
            feature, cut = np.array(t.feature), np.array(t.cut)
            low, high, value = np.array(t.low), np.array(t.high), np.array(t.value)
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                here = at[inner]
                at[inner] = np.where(x[inner, f[inner]] <= cut[here], low[here], high[here])
            total += value[at]
        return total

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift

    def column(self, features: list[str]) -> Column:
        """The calibrated probability as an expression over numeric columns."""

        def node(t: Tree, i: int) -> str:
            if t.feature[i] < 0:
                return f"{t.value[i]!r}D"
            name = features[t.feature[i]]
            return f"CASE WHEN `{name}` <= {t.cut[i]!r}D THEN {node(t, t.low[i])} ELSE {node(t, t.high[i])} END"

        total = " + ".join([f"{self.base!r}D", *[f"({node(t, 0)})" for t in self.trees]])
        return 1 / (1 + F.exp(-(F.expr(total) * self.slope + self.shift)))


def edges_of(rows: DataFrame, features: list[str], count: str) -> list[np.ndarray]:
    """The cuts of ``boost`` per feature, from all rows, each of which stands for ``count``.

    One task holds the distinct values of a feature with their counts.
    """
    each = rows.select(F.posexplode(F.array(*features)).alias("f", "v"), F.col(count).alias("n"))
    each = each.groupBy("f", "v").agg(F.sum("n").alias("n"))
    at = ", ".join(repr(float(q)) + "D" for q in np.linspace(0, 1, BINS + 1)[1:-1])
    found = each.groupBy("f").agg(
        F.slice(F.array_sort(F.collect_set("v")), 1, BINS + 1).alias("values"), F.expr(f"percentile(v, array({at}), n)").alias("cuts")
    )
    edges = [np.zeros(0)] * len(features)
    for r in found.collect():
        values = np.array(r["values"])
        edges[r["f"]] = np.unique(r["cuts"]) if len(values) > BINS else (values[:-1] + values[1:]) / 2
    return edges


def bins_of(features: list[str], edges: list[np.ndarray]) -> list[Column]:
    """The number of every feature's bin: how many of its cuts are below the value."""
    def bin_of(f: str, cuts: np.ndarray) -> Column:
        if not len(cuts):
            return F.lit(0).alias(f)
        return F.size(F.filter(F.array(*[F.lit(float(e)) for e in cuts]), lambda e: e < F.col(f))).alias(f)

    return [bin_of(f, cuts) for f, cuts in zip(features, edges)]


def values_of(bins: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """A value in each bin."""
    return np.stack([np.append(cuts, np.inf)[bins[:, f]] for f, cuts in enumerate(edges)], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _grow(tree, node, rows, binned, edges, g, h, count, depth, least, ridge, rate):
    def leaf(total_g, total_h):
        return float(-rate * total_g / (total_h + ridge))

    sum_g, sum_h = g[rows].sum(), h[rows].sum()
    tree.value[node] = leaf(sum_g, sum_h)
    total = count[rows].sum()
    if depth == 0 or total < 2 * least:
        return
    best = (1e-6, -1, -1)
    for f in range(binned.shape[1]):
        size = len(edges[f]) + 1
        if size < 2:
            continue
        b = binned[rows, f]
        n = np.cumsum(np.bincount(b, count[rows], size))[:-1]
        lg = np.cumsum(np.bincount(b, g[rows], size))[:-1]
        lh = np.cumsum(np.bincount(b, h[rows], size))[:-1]
        gain = lg**2 / (lh + ridge) + (sum_g - lg) ** 2 / (sum_h - lh + ridge) - sum_g**2 / (sum_h + ridge)
        gain[(n < least) | (total - n < least)] = -1
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (float(gain[at]), f, at)
    _, f, at = best
    if f < 0:
        return
    goes_low = binned[rows, f] <= at
    tree.feature[node], tree.cut[node] = f, float(edges[f][at])
    for side, part in (("low", rows[goes_low]), ("high", rows[~goes_low])):
        child = tree.add(0.0)
        getattr(tree, side)[node] = child
        _grow(tree, child, part, binned, edges, g, h, count, depth - 1, least, ridge, rate)


def boost(
    x: np.ndarray,
    y: np.ndarray,
    weight: np.ndarray | None = None,
    trees: int = 40,
    depth: int = 3,
    rate: float = 0.2,
    least: int = 10,
    ridge: float = 1.0,
    edges: list[np.ndarray] | None = None,
    count: np.ndarray | None = None,
) -> Forest:
    """Boosted trees on the logistic loss, splits at quantiles, or at ``edges`` per feature. One class, or no
    rows, give a constant. A row may stand for ``count`` equal ones.
    """
    count = np.ones(len(y)) if count is None else count
    w = count if weight is None else weight * count
    ones, zeros = w[y == 1].sum(), w[y == 0].sum()
    base = float(np.log((ones + 1) / (zeros + 1)))
    if not ones or not zeros:
        return Forest(base, [])
    if edges is None:
        edges = []
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            if len(values) > BINS:
                edges.append(np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])))
            else:
                edges.append((values[:-1] + values[1:]) / 2)
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    forest, z = Forest(base, []), np.full(len(y), base)
    for _ in range(trees):
        p = _sigmoid(z)
        tree = Tree()
        tree.add(0.0)
        _grow(tree, 0, np.arange(len(y)), binned, edges, w * (p - y), w * p * (1 - p), count, depth, least, ridge, rate)
        forest.trees.append(tree)
        z = z + Forest(0.0, [tree]).raw(x)
    return forest


def calibrate(forest: Forest, x: np.ndarray, y: np.ndarray, count: np.ndarray | None = None) -> Forest:
    """Fit slope and shift of the log-odds on rows that the trees have not seen; a row stands for ``count``."""
    z, a, b = forest.raw(x), 1.0, 0.0
    c = np.ones(len(y)) if count is None else count
    ones, zeros = c[y == 1].sum(), c[y == 0].sum()
    if not ones or not zeros:
        return forest
    # Targets a little inside 0 and 1, so that separable rows give finite values.
    t = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    for _ in range(50):
        p = _sigmoid(a * z + b)
        r, v = c * (p - t), c * (p * (1 - p) + 1e-9)
        grad = np.array([(r * z).sum() + 1e-3 * (a - 1), r.sum()])
        hess = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    if not np.isfinite([a, b]).all() or a <= 0:
        return forest
    return Forest(forest.base, forest.trees, float(a), float(b))


def threshold_for(p: np.ndarray, y: np.ndarray, precision: float, count: np.ndarray | None = None) -> float:
    """The smallest threshold at which rows not seen in fitting are right often enough; 1.01 if none."""
    order = np.argsort(-p, kind="stable")
    c = (np.ones(len(y)) if count is None else count)[order]
    right = np.cumsum(y[order] * c) / np.cumsum(c)
    # Rows of equal score are taken together.
    last = np.concatenate([p[order][1:] != p[order][:-1], [True]])
    good = np.flatnonzero((right >= precision) & last)
    return float(p[order][good[-1]]) if len(good) else 1.01
