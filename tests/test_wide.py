"""Wide designs: dummies as indices give what a dense matrix gives."""

import numpy as np
import pytest

from gramlake.operators import covariance, linear, sparse
from gramlake.operators.terms import Design, cat, num


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 4000
    g, h = np.minimum(rng.geometric(0.03, n), 60), rng.integers(0, 40, n)
    g[: n // 3] = 7  # a hot level
    x, z, w = rng.normal(5, 2, n), rng.normal(0, 1, n), rng.random(n) + 0.5
    y = 3 + 2 * x - z + 0.1 * g + np.sin(h) + x * (g % 3) * 0.2 + rng.normal(0, 1, n)
    return spark.createDataFrame(list(zip(range(n), g.tolist(), h.tolist(), x.tolist(), z.tolist(), w.tolist(), y.tolist(), strict=True)), "id long, g long, h long, x double, z double, w double, y double").repartition(5, "id").cache()


DESIGNS = {
    "one": Design(["y"], [num("x"), cat("g")]),
    "two": Design(["y", "z"], [num("x"), cat("g"), cat("h")], weights="w"),
    "slopes": Design(["y"], [num("z"), cat("h"), num("x") * cat("g")], weights="w"),
    "bare": Design(["y"], [num("x"), cat("g"), cat("h")], intercept=False),
    "instruments": Design(["y"], [num("x"), cat("g")], instruments=[num("z"), cat("h")]),
}


@pytest.mark.parametrize("name", DESIGNS)
@pytest.mark.parametrize("pairs", [sparse.PAIRS, 10])
def test_sums_equal_those_of_the_dense_matrix(rows, monkeypatch, name, pairs):
    monkeypatch.setattr(sparse, "PAIRS", pairs)
    plan = DESIGNS[name].fit(rows)
    prepared = plan.rows(rows)
    shift = linear.location(prepared, plan) if DESIGNS[name].intercept else None
    monkeypatch.setattr(sparse, "WIDE", 10**9)
    want = linear.gram(prepared, plan, shift)
    monkeypatch.setattr(sparse, "WIDE", 1)
    got = linear.gram(prepared, plan, shift)
    np.testing.assert_allclose(got.m, want.m, rtol=1e-9, atol=1e-7)
    assert np.allclose([got.n, got.sw, got.slw], [want.n, want.sw, want.slw])


@pytest.mark.parametrize("kind", ["HC0", "HC1", "HC2", "HC3"])
def test_robust_errors(rows, monkeypatch, kind):
    found = []
    for wide in (1, 10**9):
        monkeypatch.setattr(sparse, "WIDE", wide)
        found.append(linear.ols(rows, DESIGNS["two"], kind))
    np.testing.assert_allclose(found[0].params, found[1].params, rtol=1e-8)
    np.testing.assert_allclose(found[0].bse, found[1].bse, rtol=1e-8)
    assert covariance is not None


def test_unseen_and_empty(spark, rows):
    plan = DESIGNS["one"].fit(rows.where("g < 50"))
    g = linear.gram(plan.rows(rows), plan)
    assert g.n == 4000 and g.xx[0, 2:].sum() < 4000
    assert linear.gram(plan.rows(rows.limit(0)), plan).n == 0


def test_levels_of_two_terms(rows):
    """A wide term eliminated level by level, beside another term's dummies, equals the whole fit."""
    whole = linear.ols(rows, Design(["y"], [num("z"), cat("g"), cat("h")], weights="w", intercept=False))
    fit, levels = linear.level_ols(rows, "y", ["g"], x=["z"], weights="w", also=["h"])
    place = {n: i for i, n in enumerate(whole.names)}
    at = [place[n] for n in fit.names]
    np.testing.assert_allclose(fit.params, whole.params[at], rtol=1e-8)
    np.testing.assert_allclose(fit.bse, whole.bse[at], rtol=1e-8)
    assert fit.df_resid == whole.df_resid
    for r in levels.collect():
        i = place[f"C(g)[{r.g}]"]
        np.testing.assert_allclose([r.coef[0], r.std_err[0]], [whole.params[i], whole.bse[i]], rtol=1e-7)


def test_levels_with_slopes_and_two_more_terms(rows):
    df = rows.selectExpr("*", "id % 4 as k")
    whole = linear.ols(df, Design(["y"], [cat("g"), num("x") * cat("g"), num("z"), cat("h"), cat("k")], intercept=False))
    fit, levels = linear.level_ols(df, "y", ["g"], slopes=["x"], x=["z"], also=["h", "k"])
    place = {n: i for i, n in enumerate(whole.names)}
    np.testing.assert_allclose(fit.params, whole.params[[place[n] for n in fit.names]], rtol=1e-6, atol=1e-9)
    r = levels.where("g = 7").first()
    want = [place["C(g)[7]"], place["x:C(g)[7]"]]
    np.testing.assert_allclose(r.coef, whole.params[want], rtol=1e-6)
    np.testing.assert_allclose(r.std_err, whole.bse[want], rtol=1e-6)


def test_two_wide_terms(spark):
    """1,000 and 5,000 levels in one fit of 60,000 rows, against sweeping out one mean after the other."""
    rng = np.random.default_rng(4)
    n = 60_000
    a, b, x = rng.integers(0, 5000, n), rng.integers(0, 1000, n), rng.normal(size=n)
    y = 0.5 * x + a % 11 + np.cos(b) + rng.normal(size=n)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), x.tolist(), y.tolist(), strict=True)), "a long, b long, x double, y double")
    fit, levels = linear.level_ols(df, "y", ["a"], x=["x"], also=["b"])
    u, v = x.copy(), y.copy()
    for _ in range(200):
        for key, size in ((a, 5000), (b, 1000)):
            count = np.maximum(np.bincount(key, minlength=size), 1)
            for c in (u, v):
                c -= (np.bincount(key, c, size) / count)[key]
    slope = u @ v / (u @ u)
    assert abs(fit.params[0] - slope) < 1e-8
    assert len(fit.names) == 1000 and levels.count() == 5000
    assert abs(fit.bse[0] - np.sqrt(((v - slope * u) ** 2).sum() / (n - 6000) / (u @ u))) < 1e-8


def test_supplier_dummies_of_more_levels_than_columns(spark, tmp_path):
    """The query takes 6,000 suppliers, as it takes few."""
    from gramlake.jobs.linear_jobs import QUERIES

    n, size = 18_000, 6000
    spark.range(n).selectExpr(f"id % {size} as l_suppkey", "cast(id * 7919 % 101 as double) as l_quantity", "cast(id * 31 % 11 as double) / 100 as l_discount", f"3D * (id * 7919 % 101) - 50D * (id * 31 % 11) + id % {size} + sin(id) as l_extendedprice").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.term: r for r in QUERIES["a1_ols_supplier_dummies_lineitem"](spark, str(tmp_path)).collect()}
    i = np.arange(n)
    x = np.stack([i * 7919 % 101, i * 31 % 11 / 100], 1).astype(float)
    y = 3.0 * x[:, 0] - 5000 * x[:, 1] + i % size + np.sin(i)
    by = lambda v: v - (v.reshape(3, size, -1).mean(0)[None].repeat(3, 0)).reshape(v.shape)
    dx, dy = by(x), by(y)
    b = np.linalg.solve(dx.T @ dx, dx.T @ dy)
    v = np.linalg.inv(dx.T @ dx) * ((dy - dx @ b) ** 2).sum() / (n - size - 2)
    assert [got[t].coef for t in ("l_quantity", "l_discount")] == pytest.approx(b.tolist(), abs=6e-4)
    assert [got[t].std_err for t in ("l_quantity", "l_discount")] == pytest.approx(np.sqrt(np.diag(v)).tolist(), abs=6e-4)
    assert got["Intercept"].coef == pytest.approx((y[::size] - x[::size] @ b).mean(), abs=6e-4) and got["Intercept"].std_err is None
