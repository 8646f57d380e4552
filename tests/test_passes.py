"""Iterative fits end where they are as near as rounding lets them come, in few passes."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from gramlake.operators import aggregates, checkloss, irls
from gramlake.operators.terms import Design, cat, num


def test_steps_of_rounding_end_a_fit(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=2000)
    near = x + 1e-4 * rng.normal(size=2000)
    y = (rng.random(2000) < 1 / (1 + np.exp(-x))).astype(float)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, near, y, strict=True)], "x double, z double, y double").persist()
    fit = irls.glm(frame, Design(["y"], [num("x"), num("z")]), "binomial", tol=0.0)
    m = np.stack([np.ones(2000), x, near], 1)
    score = m.T @ (y - 1 / (1 + np.exp(-m @ fit.params)))
    assert score @ fit.cov @ score < 1e-12
    assert fit.stats["converged"] and fit.stats["iterations"] < 30


def test_robust_fits_and_medians_take_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n = 30_001
    x, e = rng.normal(size=n), rng.standard_t(3, n)
    frame = spark.createDataFrame([(float(a), float(1 + 2 * a + b)) for a, b in zip(x, e, strict=True)], "x double, y double").repartition(3).persist()
    passes, plain = [], irls.sum_rows
    monkeypatch.setattr(irls, "sum_rows", lambda rows, kernel: passes.append(kernel) or plain(rows, kernel))
    m, y = np.stack([np.ones(n), x], 1), 1 + 2 * x + e
    for norm in ("HuberT", "TukeyBiweight"):
        passes.clear()
        fit = irls.rlm(frame, Design(["y"], [num("x")]), norm, tol=1e-11)
        z = (y - m @ fit.params) / fit.stats["scale"]
        assert abs(fit.stats["scale"] * 0.6744897501960817 - np.median(np.abs(y - m @ fit.params))) < 1e-9
        assert np.abs(m.T @ (irls._psi(norm, z)[1] * z)).max() < 1e-6
        assert len(passes) < 20


def test_medians_of_ties_and_wide_ranges(spark):
    rng = np.random.default_rng(5)
    for y in (np.repeat([1.0, 2.0, 2.0, 7.0], 15_000), np.concatenate([np.zeros(3), [5.0, 6.0, 9.0, 11.0]]), np.exp(rng.normal(0, 9, 50_000)), np.array([3.0])):
        rows = spark.createDataFrame([(float(v), 1.0) for v in y], "y0 double, w double").repartition(3)
        plan = Design(["y0"], []).fit(rows)
        for near in (0.0, float(np.median(y)) * 1.01, 1e-5):
            seen = {"density": len(y) / 10.0} if near == 1e-5 else {}
            got = irls._medians_abs(rows, plan, np.array([[0.0], [0.5]]), len(y), near, 0.1, seen)
            assert np.allclose(got, [np.median(np.abs(y)), np.median(np.abs(y - 0.5))], rtol=1e-12)


def test_values_of_quantiles_carry_no_ranks(spark, monkeypatch):
    seen, plain = [], aggregates.cut
    monkeypatch.setattr(aggregates, "cut", lambda df: seen.append(df.columns) or plain(df))
    values = np.random.default_rng(6).normal(size=300)
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = aggregates.quantiles(frame, F.col("v"), [0.1, 0.5], keep=4, bins=4).first()
    assert np.allclose(got.q, np.quantile(values, [0.1, 0.5]))
    rows = [c for c in seen if "v" in c]
    assert rows and not any("ranks" in c for c in rows)


def test_quantile_fits_take_few_passes_however_small_the_sample(spark, monkeypatch):
    rng = np.random.default_rng(7)
    n, taus = 20_000, [0.2, 0.5]
    x, z = rng.normal(size=n) + 30, rng.normal(size=n)
    y = 1 + 2 * x + z + rng.standard_t(3, n)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, z, y, strict=True)], "x double, z double, y double").repartition(3).persist()
    passes, plain = [], irls.sum_rows
    for module in (irls, checkloss):
        monkeypatch.setattr(module, "sum_rows", lambda rows, kernel: passes.append(kernel) or plain(rows, kernel))
    monkeypatch.setattr(irls, "START_ROWS", 500)
    monkeypatch.setattr(checkloss, "BAND_ROWS", 400)
    fits = irls.quantile_regression(frame, Design(["y"], [num("x"), num("z")]), taus)
    assert len(passes) < 12
    m = np.stack([np.ones(n), x, z], 1)
    for tau, f in fits.items():
        r = y - m @ f.params
        d, proven = checkloss.vertex(m, r, np.ones(n), np.zeros(3), tau)
        assert f.stats["exact"] and proven and np.abs(m @ d).max() < 1e-7
    bare = irls.quantile_regression(frame, Design(["y"], [num("x"), num("z")]), taus, None)
    for tau, f in fits.items():
        assert np.allclose(bare[tau].params, f.params, atol=1e-8) and abs(bare[tau].stats["cost"] / f.stats["cost"] - 1) < 1e-12 and bare[tau].stats["exact"]


def test_quantiles_between_two_values_share_passes(spark):
    rng = np.random.default_rng(8)
    for v in (rng.normal(size=1000), np.repeat([1.0, 2.0], 50), np.array([3.0, 3.0]), np.array([1.0, 5.0]), np.exp(rng.normal(0, 9, 501))):
        frame = spark.createDataFrame([(float(a),) for a in v], "v double")
        assert np.isclose(aggregates.exact_quantile(frame, F.col("v"), 0.5, 4, 3), np.quantile(v, 0.5), rtol=1e-12)


def test_robust_fits_of_numbers_add_up_built_in_sums(spark, monkeypatch):
    rng = np.random.default_rng(9)
    n = 1_501
    x, z, g = rng.normal(size=n) + 5, rng.normal(size=n), rng.integers(0, 3, n)
    y = 1 + 2 * x - z + 0.5 * g + rng.standard_t(3, n)
    frame = spark.createDataFrame([(float(a), float(b), str(c), float(c == 1), float(c == 2), float(1 + i % 3), float(v)) for i, (a, b, c, v) in enumerate(zip(x, z, g, y, strict=True))], "x double, z double, g string, g1 double, g2 double, h double, y double").repartition(3).persist()
    passes, plain = [], irls.sum_rows
    monkeypatch.setattr(irls, "sum_rows", lambda rows, kernel: passes.append(kernel) or plain(rows, kernel))
    numbers = Design(["y"], [num("x"), num("z"), num("g1"), num("g2")], weights="h")
    for norm in ("HuberT", "TukeyBiweight", "TrimmedMean", "AndrewWave", "RamsayE", "LeastSquares"):
        passes.clear()
        fit = irls.rlm(frame, numbers, norm, tol=1e-9)
        assert not passes
        with monkeypatch.context() as m:
            m.setattr(irls, "BUILT_IN", 0)
            others = [irls.rlm(frame, numbers, norm, tol=1e-9)]
        if norm == "HuberT":
            others.append(irls.rlm(frame, Design(["y"], [num("x"), num("z"), cat("g")], weights="h"), norm, tol=1e-9))
        assert passes
        for other in others:
            assert np.allclose(fit.params, other.params, rtol=1e-7) and np.isclose(fit.stats["scale"], other.stats["scale"], rtol=1e-7) and np.isclose(fit.stats["cost"], other.stats["cost"], rtol=1e-7)
            assert all(np.allclose(v, other.covariances[kind], rtol=1e-6) for kind, v in fit.covariances.items())
    with pytest.raises(ValueError, match="no valid rows"):
        irls.rlm(frame.where("x > 99"), numbers)


def test_steps_of_rounding_end_a_robust_fit(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=1000)
    frame = spark.createDataFrame([(float(a), float(1000 + 2 * a + b)) for a, b in zip(x, rng.standard_t(3, 1000), strict=True)], "x double, y double").repartition(2).persist()
    fit, near = irls.rlm(frame, Design(["y"], [num("x")]), "TukeyBiweight", tol=0.0), irls.rlm(frame, Design(["y"], [num("x")]), "TukeyBiweight", tol=1e-11)
    assert fit.stats["converged"] and fit.stats["iterations"] < 20 and np.allclose(fit.params, near.params, rtol=1e-10)


def test_medians_at_powers_of_two(spark):
    for power in (-200, -3, 29, 31, 1000):
        y = np.array([0.0, 0.5, 1.0, 1.0, 1.0, 1.5, 7.0]) * 2.0**power
        rows = spark.createDataFrame([(float(v), 1.0) for v in y], "y0 double, w double").repartition(2)
        assert irls._medians_abs(rows, Design(["y0"], []).fit(rows), np.array([[0.0]]), len(y))[0] == 2.0**power
