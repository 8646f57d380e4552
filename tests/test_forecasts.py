"""Forecasts over a table of future rows, against recursions by hand."""

import numpy as np
import pytest

from gramlake.operators import series


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(16)
    rows, raw = [], {}
    for k in range(3):
        y, x = np.zeros(300), rng.normal(size=310)
        for t in range(2, 300):
            y[t] = 0.5 * y[t - 1] - 0.2 * y[t - 2] + 0.8 * x[t] + rng.normal()
        y = np.cumsum(y) if k == 2 else y
        raw[k] = (y, x)
        rows += [(k, t, float(y[t]), float(x[t])) for t in range(300)]
    rows += [(9, t, 1.0 * t, 0.5) for t in range(3)]
    past = spark.createDataFrame(rows, "k long, t long, y double, x double").repartition(4)
    future = spark.createDataFrame([(k, 300 + i, float(raw[k][1][300 + i])) for k in raw for i in range(8)] + [(9, 3, 0.5)], "k long, t long, x double").repartition(3)
    return past, future, raw


@pytest.mark.parametrize("d", [0, 1])
def test_autoregression_with_regressors(tables, d):
    past, future, raw = tables
    got = {(r.k, r.step): r for r in series.arma_forecast(past, "y", ["k"], ["t"], 2, 0, future, ("x",), d).collect()}
    for k, (y, x) in raw.items():
        z = np.diff(y, d) if d else y
        m = np.stack([np.ones(len(z) - 2), z[1:-1], z[:-2], x[d + 2 : 300]], 1)
        b, *_ = np.linalg.lstsq(m, z[2:], rcond=None)
        s2 = ((z[2:] - m @ b) ** 2).sum() / (len(m) - 4)
        h, level, psi = list(z[-2:]), y[-1], [0.0, 1.0]
        total = 0.0
        weights = []
        for i in range(8):
            h.append(b[0] + b[1] * h[-1] + b[2] * h[-2] + b[3] * x[300 + i])
            level = level + h[-1] if d else h[-1]
            weights.append(psi[-1] + (weights[-1] if d and weights else 0.0))
            total += weights[-1] ** 2
            psi.append(b[1] * psi[-1] + b[2] * psi[-2])
            r = got[k, i + 1]
            assert r.t == 300 + i and r.mean == pytest.approx(level, rel=1e-8) and r.variance == pytest.approx(s2 * total, rel=1e-8)
    assert got[9, 1].mean is None


def test_moving_average_and_edges(spark, tables):
    past, future, _ = tables
    fit = series.arma(past, "y", ["k"], ["t"], 1, 1).where("k = 0").first().coef
    got = [r.mean for r in series.arma_forecast(past.where("k = 0"), "y", ["k"], ["t"], 1, 1, future.select("k", "t")).orderBy("step").collect() if r.k == 0]
    assert all(got[i + 1] == pytest.approx(fit[0] + fit[1] * got[i], rel=1e-9) for i in range(7))
    assert series.arma_forecast(past, "y", ["k"], ["t"], 1, 1, future.limit(0)).count() == 0
    assert [r.mean for r in series.arma_forecast(past.limit(0), "y", ["k"], ["t"], 1, 1, future.where("k = 9")).collect()] == [None]
