"""Exact quantile fits: no fit through any p rows is better, in memory and over a table with few rows in the band."""

import itertools

import numpy as np
import pytest

from gramlake.operators import checkloss, irls
from gramlake.operators.terms import Design, num


def loss(x, y, w, b, tau):
    r = y - x @ b
    return (w * r * (tau - (r < 0))).sum()


@pytest.mark.parametrize("kind", ["plain", "ties", "weights"])
def test_vertex_is_the_best_of_all_bases(kind):
    rng = np.random.default_rng(5)
    n, p = 24, 3
    x = np.column_stack([np.ones(n), rng.normal(size=n), rng.normal(size=n)])
    y, w = x @ [1.0, 2.0, -1.0] + rng.standard_t(2, n), np.ones(n)
    if kind == "ties":
        x[:, 1], x[:, 2], y = rng.integers(0, 3, n), rng.integers(0, 2, n), rng.integers(0, 4, n).astype(float)
    elif kind == "weights":
        w = rng.uniform(0.1, 3, n)
    for tau in (0.1, 0.37, 0.5, 0.9):
        best = min(loss(x, y, w, np.linalg.solve(x[list(i)], y[list(i)]), tau) for i in itertools.combinations(range(n), p) if abs(np.linalg.det(x[list(i)])) > 1e-9)
        d, proven = checkloss.vertex(x, y, w, np.zeros(p), tau)
        assert proven and loss(x, y, w, d, tau) == pytest.approx(best, rel=1e-12)


def test_fits_of_a_table_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 1500
    a, b = rng.normal(size=n) + 50, rng.integers(0, 5, n).astype(float)
    y = a * 2 - b + rng.standard_t(2, n) * (1 + b)
    df = spark.createDataFrame([(float(i), float(j), float(j), float(k)) for i, j, k in zip(a, b, y, strict=True)], "a double, b double, same double, y double").repartition(4)
    x = np.column_stack([np.ones(n), a, b])
    monkeypatch.setattr(checkloss, "BAND_ROWS", 200)
    fits = irls.quantile_regression(df, Design(["y"], [num("a"), num("b"), num("same")]), [0.2, 0.5])
    for tau, f in fits.items():
        want, proven = checkloss.vertex(x, y, np.ones(n), np.zeros(3), tau)
        got = np.array([f.params[0], f.params[1], f.params[2] + f.params[3]])
        assert proven and f.stats["exact"] and got == pytest.approx(want, abs=1e-7)
        assert (np.abs(y - x @ got) < 1e-8).sum() >= 3
