"""Shapley values of tree ensembles from per-leaf tables.

Path-dependent TreeSHAP looks at one leaf at a time: of the d features on the leaf's path,
each is *on* (the row meets all its splits on the path) or off, and the leaf's part of every
Shapley value depends on the row through these d bits alone.  So the values of all 2^d
patterns are tabulated for each leaf once, and a row then costs one pattern and one look-up
per leaf and feature.

For a leaf of value v and features with cover ratios z (product over the feature's splits)
and bits o, the value function of a set S of features is v * prod(S: o) * prod(others: z).  From it
follow, with sums over the S that hold neither of the features named,

* the value of feature i: v (o_i - z_i) sum of |S|! (d - 1 - |S|)! / d! * prod(S: o) prod(others: z)
* the interaction of i and j: v (o_i - z_i)(o_j - z_j) sum of |S|! (d - 2 - |S|)! / (2 (d - 1)!) * the same product
* the main effect of i: its value without its interactions.

The sums over sets of one size are coefficients of the polynomial prod(z + o t)."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np

#: Features on a path up to which all 2^d patterns of a tree's leaves are tabulated; of wider
#: trees, each leaf only has the patterns that the rows at hand show.
MAX_FEATURES = 10


@dataclass
class Paths:
    """Leaves of one tree.  Row l, slot k: the k-th feature of the path (-1: none), the interval
    ``(low, high]`` of its values that leads to the leaf, and its cover ratio."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    ratio: np.ndarray
    value: np.ndarray

    @property
    def width(self) -> int:
        return self.feature.shape[1]


def paths(tree) -> Paths:
    """The leaves of a tree of node arrays (left, right, feature, threshold, value, cover, weight)."""
    found = []

    def walk(node: int, seen: dict) -> None:
        if tree.left[node] < 0:
            found.append((dict(seen), tree.value[node] * tree.weight))
            return
        f, t = int(tree.feature[node]), tree.threshold[node]
        low, high, ratio = seen.get(f, (-np.inf, np.inf, 1.0))
        for child, own in ((int(tree.left[node]), (low, min(high, t))), (int(tree.right[node]), (max(low, t), high))):
            walk(child, {**seen, f: (*own, ratio * tree.cover[child] / tree.cover[node])})

    walk(0, {})
    d = max(len(s) for s, _ in found)
    p = Paths(np.full((len(found), d), -1), np.full((len(found), d), -np.inf), np.full((len(found), d), np.inf),
              np.ones((len(found), d)), np.array([v for _, v in found]))
    for leaf, (seen, _) in enumerate(found):
        for k, (f, (low, high, ratio)) in enumerate(seen.items()):
            p.feature[leaf, k], p.low[leaf, k], p.high[leaf, k], p.ratio[leaf, k] = f, low, high, ratio
    return p


def patterns(x: np.ndarray, p: Paths) -> np.ndarray:
    """(rows, leaves): bit k is set if the row meets the splits of the leaf's k-th feature."""
    out = np.zeros((len(x), len(p.value)), np.int64)
    for k in range(p.width):
        used = np.flatnonzero(p.feature[:, k] >= 0)
        v = x[:, p.feature[used, k]]
        met = ~(v <= p.low[used, k]) & ((v <= p.high[used, k]) | (p.high[used, k] == np.inf))
        out[:, used] |= met.astype(np.int64) << k
    return out


def _sums(on: np.ndarray, ratio: np.ndarray, without: tuple[int, ...], weights: np.ndarray) -> np.ndarray:
    """(patterns, leaves): the weighted sums over sets S of the features but ``without``."""
    coef = np.ones((1, on.shape[0], ratio.shape[0]))
    for k in range(ratio.shape[1]):
        if k not in without:
            z, o = ratio[None, :, k], on[:, None, k]
            more = np.zeros((len(coef) + 1, *coef.shape[1:]))
            more[:-1] += coef * z
            more[1:] += coef * o
            coef = more
    return np.tensordot(weights, coef, axes=1)


@dataclass
class Tables:
    """Entries of one tree: the value ``table[e, pattern of leaf[e]]`` adds to column ``column[e]`` (ascending)."""

    paths: Paths
    leaf: np.ndarray
    column: np.ndarray
    table: np.ndarray

    @property
    def nbytes(self) -> int:
        return self.table.nbytes


def tables(p: Paths, columns: dict[tuple[int, ...], int], seen: np.ndarray | None = None) -> Tables:
    """Tables of the asked columns: (i,) for the value of feature i, (i, i) for its main effect,
    (i, j) with i < j for an interaction.  They have a column for each of the patterns ``seen`` (all by default)."""
    bits = 1 << np.arange(p.width)
    seen = np.arange(1 << p.width) if seen is None else seen
    on = (seen[:, None] & bits[None, :] > 0).astype(np.float64)
    sizes = (p.feature >= 0).sum(axis=1)
    leaf, column, table = [], [], []
    for d in np.unique(sizes[sizes > 0]).tolist():              # leaves of equally many features together
        own = np.flatnonzero(sizes == d)
        z, o, v, f = p.ratio[own, :d], on[:, :d], p.value[own], p.feature[own, :d]
        delta = [o[:, None, k] - z[None, :, k] for k in range(d)]
        single = np.array([math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)])
        double = np.array([math.factorial(s) * math.factorial(d - 2 - s) / (2 * math.factorial(d - 1)) for s in range(d - 1)])
        mains = {f_[0] for f_ in columns if len(f_) == 2 and f_[0] == f_[1]}
        wanted_pairs = {frozenset(c) for c in columns if len(c) == 2 and c[0] != c[1]}

        def add(key: np.ndarray, values: np.ndarray) -> None:
            """values (patterns, leaves); key: the column of each leaf, -1 for none."""
            ok = np.flatnonzero(key >= 0)
            leaf.append(own[ok])
            column.append(key[ok])
            table.append(values[:, ok].T)

        value = {k: v * delta[k] * _sums(o, z, (k,), single) for k in range(d)
                 if any((int(x),) in columns or int(x) in mains for x in f[:, k])}
        inter = {}
        for a, b in itertools.combinations(range(d), 2):
            names = [(int(x), int(y)) for x, y in f[:, [a, b]]]
            if any(frozenset(n) in wanted_pairs or mains & set(n) for n in names):
                inter[a, b] = v * delta[a] * delta[b] * _sums(o, z, (a, b), double)
                add(np.array([columns.get((min(n), max(n)), -1) for n in names]), inter[a, b])
        for k, val in value.items():
            add(np.array([columns.get((int(x),), -1) for x in f[:, k]]), val)
            main = np.array([columns.get((int(x), int(x)), -1) for x in f[:, k]])
            if (main >= 0).any():
                add(main, val - sum((t for pair, t in inter.items() if k in pair), np.zeros_like(val)))
    if not leaf:
        return Tables(p, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(seen))))
    leaf, column, table = np.concatenate(leaf), np.concatenate(column), np.concatenate(table)
    order = np.argsort(column, kind="stable")
    return Tables(p, leaf[order], column[order], np.ascontiguousarray(table[order]))


def add_values(out: np.ndarray, x: np.ndarray, t: Tables, rows: int = 1024) -> None:
    """Add the tree's columns for the rows ``x`` to ``out`` (rows, columns)."""
    if not len(t.leaf):
        return
    starts = np.flatnonzero(np.append(True, t.column[1:] != t.column[:-1]))
    base, flat = np.arange(len(t.leaf)) * t.table.shape[1], t.table.reshape(-1)
    for at in range(0, len(x), rows):
        seen = patterns(x[at:at + rows], t.paths)
        out[at:at + rows, t.column[starts]] += np.add.reduceat(flat[seen[:, t.leaf] + base], starts, axis=1)


def add_wide_values(out: np.ndarray, x: np.ndarray, p: Paths, columns: dict[tuple[int, ...], int]) -> None:
    """Like ``add_values``, for a tree with too many features on a path: a leaf at a time, and only the patterns that occur."""
    for k in range(len(p.value)):
        d = max(1, int((p.feature[k] >= 0).sum()))
        one = Paths(*[getattr(p, name)[k:k + 1, :d] for name in ("feature", "low", "high", "ratio")], p.value[k:k + 1])
        seen, of = np.unique(patterns(x, one)[:, 0], return_inverse=True)
        t = tables(one, columns, seen)
        for column, row in zip(t.column.tolist(), t.table):
            out[:, column] += row[of]
