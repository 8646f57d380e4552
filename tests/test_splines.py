"""Splines in blocks against those solved at once, and rows that meet their pieces by blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlake.operators import joins, splines


def curve(n, seed=4):
    rng = np.random.default_rng(seed)
    return np.cumsum(rng.uniform(0.1, 2, n)), rng.normal(size=n)


def test_quadratic_pieces_meet_midway_with_equal_slopes():
    x, y = curve(30)
    p = splines.pieces_of(x, y, "quadratic")
    assert len(p) == 28
    at = lambda k, v: (lambda u: (p[k, 2] + p[k, 3] * u + p[k, 4] * u * u, p[k, 3] + 2 * p[k, 4] * u))(v - p[k, 1])
    for k in range(28):
        assert at(k, x[k + 1])[0] == pytest.approx(y[k + 1])
        if k:
            assert p[k, 0] == pytest.approx((x[k] + x[k + 1]) / 2) and at(k, p[k, 0]) == pytest.approx(at(k - 1, p[k, 0]))
    assert at(0, x[0])[0] == pytest.approx(y[0]) and at(27, x[-1])[0] == pytest.approx(y[-1]) and p[0, 0] == x[0]
    assert splines.pieces_of(x[:3], x[:3] ** 2, "quadratic")[:, 4] == pytest.approx([1.0])


@pytest.mark.parametrize("kind, bc", [("linear", ""), ("quadratic", ""), ("cubic", "natural"), ("cubic", "clamped"), ("cubic", "not-a-knot")])
def test_blocks_equal_one_sweep(spark, kind, bc):
    x, y = curve(53)
    want = splines.pieces_of(x, y, kind, bc)
    if kind == "cubic":
        assert want[:, 2:] == pytest.approx(joins.spline_coefficients(x, y, bc), abs=1e-9)
    knots = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double").repartition(5, F.hash("y"))
    for block in (4, 10, 100):
        got = np.array([tuple(r)[1:] for r in splines.pieces(knots, kind, bc, block).orderBy("lo").collect()])
        assert got == pytest.approx(want, abs=1e-9)


def test_rows_meet_pieces_in_blocks(spark, monkeypatch):
    """Places before, at, between and after the knots, nulls, and one block with most rows in several tasks."""
    x, y = curve(40)
    values = [float(v) for v in np.linspace(x[0] - 3, x[-1] + 3, 200)] + [float(v) for v in x] + [None, float("nan")] + [float(x[7]) + 0.01] * 900
    df = spark.createDataFrame([(i, v, "s", 1) for i, v in enumerate(values)], "id long, v double, _row string, a int").repartition(6, "id")
    knots = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (float(x[3]), 99.0)], "kx double, ky double")
    for kind, derivative in (("cubic", 0), ("cubic", 2), ("quadratic", 1), ("linear", 0), ("linear", 1)):
        small = {r.id: r.out for r in joins.spline_eval(df, "v", knots, "kx", "ky", derivative=derivative, name="out", kind=kind).collect()}
        with monkeypatch.context() as m:
            m.setattr(joins, "BROADCAST_KNOTS", 10)
            m.setattr(splines.pieces, "__defaults__", ("cubic", "not-a-knot", 6))
            m.setattr(splines.evaluate, "__defaults__", (0, "y", 50))
            large = joins.spline_eval(df, "v", knots, "kx", "ky", derivative=derivative, name="out", kind=kind)
            rows = large.collect()
        assert large.columns == [*df.columns, "out"] and len(rows) == len(values)
        assert all((r.out is None) == (small[r.id] is None) and (r.out is None or r.out == pytest.approx(small[r.id], abs=1e-8)) for r in rows)
        assert small[240] is None and small[241] is None
