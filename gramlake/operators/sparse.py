"""Sums of wide designs: dummies stay level indices, and products are added up where the indices point.

A row of a design with dummies has few values that aren't 0: its dense columns, and one for each value of each categorical
term. No block of dummies is ever made: a task adds a batch's products to one flat array, which holds

* the products of dense columns with one another,
* for each term the sums by level of its values times the dense columns, and times one another,
* for each two terms the sums by pair of levels, as long as there are PAIRS of them at most; more are added up by Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.operators.rows import add_rows
from gramlake.operators.terms import Plan

#: Dummies of a design from which on they stay indices; fewer are cheaper as columns.
WIDE = 24
#: Pairs of levels of two terms up to which tasks hold their sums; more go by a shuffle on the pair.
PAIRS = 250_000


@dataclass
class Levels:
    """A categorical term: where its indices and values are, how many levels, values and skipped levels it has, and its first column."""

    part: str
    term: int
    levels: int
    values: int
    plain: bool
    drop: int
    base: int


@dataclass
class Layout:
    """Where the columns of [X Y Z] are: places of the dense ones, and the categorical terms."""

    width: int
    dense: np.ndarray
    terms: list[Levels]
    pairs: list[tuple[int, int]]
    slots: list[slice]
    length: int

    @property
    def dummies(self) -> int:
        return sum(t.levels * t.values for t in self.terms)


def layout(plan: Plan, outcomes: bool = True) -> Layout:
    """X with its outcomes and instruments; X alone without ``outcomes``."""
    at, dense, terms = 0, [], []
    for part in ("x", "z") if outcomes and plan.design.instruments else ("x",):
        if plan.design.intercept:
            dense.append(at)
            at += 1
        for i, (t, found, drop) in enumerate(plan._parts(part)):
            n = len(t.names)
            if found is None:
                dense += range(at, at + n)
                at += n
            else:
                terms.append(Levels(part, i, len(found) - drop, n, t.names == ["1"], drop, at))
                at += n * (len(found) - drop)
        if part == "x" and outcomes:
            dense += range(at, at + len(plan.design.y))
            at += len(plan.design.y)
    d = len(dense)
    size = lambda t: (t.levels + 1) * t.values
    pairs = [(a, b) for a in range(len(terms)) for b in range(a + 1, len(terms)) if size(terms[a]) * size(terms[b]) <= PAIRS]
    lengths = [d * d] + [size(t) * d for t in terms] + [size(t) * t.values for t in terms] + [size(terms[a]) * size(terms[b]) for a, b in pairs]
    ends = np.cumsum([0, *lengths]).tolist()
    return Layout(at, np.array(dense, int), terms, pairs, [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)], ends[-1])


def _columns(plan: Plan, lay: Layout, c: dict[str, np.ndarray], shift: np.ndarray | None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The dense columns, and each term's level (behind the last: none) and values."""
    n, out = len(c["w"]), []
    for part in ("x", "z") if any(t.part == "z" for t in lay.terms) or lay.width > len(plan.names) + len(plan.design.y) else ("x",):
        out += [np.ones(n)] if plan.design.intercept else []
        for i, (t, found, _) in enumerate(plan._parts(part)):
            out += [c[f"{part}{i}_{j}"] for j in range(len(t.names))] if found is None else []
        if part == "x" and lay.width > len(plan.names):
            out += [c[f"y{j}"] for j in range(len(plan.design.y))]
    dense = np.stack(out, 1) if out else np.zeros((n, 0))
    moved = np.concatenate([plan.shift.get("x", np.zeros(len(plan.names))), np.zeros(len(plan.design.y)), plan.shift.get("z", np.zeros(len(plan.z_names)))])[lay.dense]
    dense = dense - (moved if shift is None else moved + shift[lay.dense])
    terms = []
    for t in lay.terms:
        level = c[f"{t.part}{t.term}_l"].astype(np.int64) - t.drop
        level[level < 0] = t.levels
        terms.append((level, np.ones((n, 1)) if t.plain else np.stack([c[f"{t.part}{t.term}_{j}"] for j in range(t.values)], 1)))
    return dense, terms


def add_products(plan: Plan, lay: Layout, c: dict[str, np.ndarray], w: np.ndarray, total: np.ndarray, shift: np.ndarray | None = None) -> None:
    """Add a batch's weighted products to ``total``, in place."""
    dense, terms = _columns(plan, lay, c, shift)
    d, k = dense.shape[1], len(terms)
    weighted = dense * w[:, None]
    total[lay.slots[0]] += (dense.T @ weighted).ravel()
    for a, (t, (level, values)) in enumerate(zip(lay.terms, terms, strict=True)):
        by_dense = total[lay.slots[1 + a]].reshape(t.levels + 1, t.values, d)
        by_values = total[lay.slots[1 + k + a]].reshape(t.levels + 1, t.values, t.values)
        for j in range(t.values):
            for i in range(d):
                by_dense[:, j, i] += np.bincount(level, values[:, j] * weighted[:, i], t.levels + 1)
            for i in range(t.values):
                by_values[:, j, i] += np.bincount(level, values[:, j] * values[:, i] * w, t.levels + 1)
    for slot, (a, b) in zip(lay.slots[1 + 2 * k :], lay.pairs, strict=True):
        (one, left), (two, right) = terms[a], terms[b]
        t, u = lay.terms[a], lay.terms[b]
        both = total[slot].reshape(t.values, u.values, -1)
        for i in range(t.values):
            for j in range(u.values):
                np.add.at(both[i, j], one * (u.levels + 1) + two, left[:, i] * right[:, j] * w)


def unpack(lay: Layout, total: np.ndarray) -> np.ndarray:
    """The symmetric matrix of sums that a flat array stands for (pairs beyond PAIRS are 0)."""
    m, d, k = np.zeros((lay.width, lay.width)), len(lay.dense), len(lay.terms)
    m[np.ix_(lay.dense, lay.dense)] = total[lay.slots[0]].reshape(d, d)
    place = lambda t, j: np.arange(t.base + j * t.levels, t.base + (j + 1) * t.levels)
    for a, t in enumerate(lay.terms):
        by_dense = total[lay.slots[1 + a]].reshape(t.levels + 1, t.values, d)[:-1]
        by_values = total[lay.slots[1 + k + a]].reshape(t.levels + 1, t.values, t.values)[:-1]
        for j in range(t.values):
            m[np.ix_(place(t, j), lay.dense)] = by_dense[:, j]
            m[np.ix_(lay.dense, place(t, j))] = by_dense[:, j].T
            for i in range(t.values):
                m[place(t, j), place(t, i)] = by_values[:, j, i]
    for slot, (a, b) in zip(lay.slots[1 + 2 * k :], lay.pairs, strict=True):
        t, u = lay.terms[a], lay.terms[b]
        both = total[slot].reshape(t.values, u.values, t.levels + 1, u.levels + 1)[:, :, :-1, :-1]
        for i in range(t.values):
            for j in range(u.values):
                m[np.ix_(place(t, i), place(u, j))] = both[i, j]
                m[np.ix_(place(u, j), place(t, i))] = both[i, j].T
    return m


def products(rows: DataFrame, plan: Plan, lay: Layout, shift: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """n, sum of w and of log w, and the weighted products of all columns over the rows. One pass, and one for each two terms beyond PAIRS."""

    def kernel(c, total):
        w = c["w"]
        total[:3] += len(w), w.sum(), np.log(w).sum()
        add_products(plan, lay, c, w, total[3:], shift)

    s = add_rows(rows, 3 + lay.length, kernel)
    m = unpack(lay, s[3:])
    held = set(lay.pairs)
    for a in range(len(lay.terms)):
        for b in range(a + 1, len(lay.terms)):
            if (a, b) not in held:
                _pair(rows, lay.terms[a], lay.terms[b], m)
    return s[:3], m


def _pair(rows: DataFrame, t: Levels, u: Levels, m: np.ndarray) -> None:
    """Sums by pair of levels from a built-in aggregate: what moves and what the driver gets are the pairs that occur."""
    one, two = F.col(f"{t.part}{t.term}_l") - t.drop, F.col(f"{u.part}{u.term}_l") - u.drop
    value = lambda v, j: F.lit(1.0) if v.plain else F.col(f"{v.part}{v.term}_{j}")
    sums = [F.sum(value(t, i) * value(u, j) * F.col("w")).alias(f"s{i}_{j}") for i in range(t.values) for j in range(u.values)]
    found = rows.groupBy(one.alias("a"), two.alias("b")).agg(*sums).where("a >= 0 and b >= 0").toArrow()
    a, b = found["a"].to_numpy(), found["b"].to_numpy()
    for i in range(t.values):
        for j in range(u.values):
            v = found[f"s{i}_{j}"].to_numpy()
            m[t.base + i * t.levels + a, u.base + j * u.levels + b] = v
            m[u.base + j * u.levels + b, t.base + i * t.levels + a] = v


def dot(plan: Plan, lay: Layout, c: dict[str, np.ndarray], beta: np.ndarray) -> np.ndarray:
    """X beta of a batch; ``lay`` without outcomes."""
    dense, terms = _columns(plan, lay, c, None)
    out = dense @ beta[lay.dense]
    for t, (level, values) in zip(lay.terms, terms, strict=True):
        for j in range(t.values):
            out += values[:, j] * np.append(beta[t.base + j * t.levels : t.base + (j + 1) * t.levels], 0.0)[level]
    return out


def quadratic(plan: Plan, lay: Layout, c: dict[str, np.ndarray], a: np.ndarray) -> np.ndarray:
    """x'Ax of every row of a batch, from the few columns that a row has."""
    dense, terms = _columns(plan, lay, c, None)
    out = np.einsum("ij,jk,ik->i", dense, a[np.ix_(lay.dense, lay.dense)], dense)
    places = []
    for t, (level, values) in zip(lay.terms, terms, strict=True):
        seen = level < t.levels
        places += [(t.base + j * t.levels + np.where(seen, level, 0), values[:, j] * seen) for j in range(t.values)]
    for i, (p, v) in enumerate(places):
        out += 2 * v * np.einsum("ij,ij->i", dense, a[np.ix_(lay.dense, np.arange(lay.width))].T[p]) + v * v * a[p, p]
        for q, u in places[:i]:
            out += 2 * v * u * a[p, q]
    return out
