"""Fits of columns whose means are large against their deviations equal those of the same columns about their means."""

import numpy as np
import pytest

from gramlake.operators import irls, linear, mle, moments_fits, penalized, resample
from gramlake.operators.terms import Design, cat, num

MEAN = 1e6
N = 3000


@pytest.fixture(scope="module")
def tables(spark):
    """The rows with columns near 0, with columns near MEAN, and these sorted so that the first rows lie far from the mean."""
    rng = np.random.default_rng(1)
    z, x2, e, u = rng.normal(size=(4, N))
    x = np.round(z + 0.5 * u, 6)
    z, x2 = np.round(z, 6), np.round(x2, 6)
    g = rng.integers(0, 30, N)
    y = np.round(1 + 2 * x - x2 + 0.3 * u + e, 6)
    b = (rng.random(N) < 1 / (1 + np.exp(-x + 0.5 * x2))).astype(float)
    c = rng.poisson(np.exp(0.2 + 0.4 * x - 0.2 * x2)).astype(float)
    rows = [tuple(map(float, r)) for r in np.stack([x, x2, z, y, b, c], 1)]
    make = lambda rows: spark.createDataFrame([(i, int(k), f"l{k % 3}", *r) for i, (r, k) in enumerate(zip(rows, g.tolist(), strict=True))], "id long, g long, kind string, x double, x2 double, z double, y double, b double, c double").repartition(3, "id").cache()
    far = [(r[0] + MEAN, r[1] - MEAN, r[2] + MEAN, r[3] + MEAN, r[4], r[5]) for r in rows]
    return make(rows), make(far)


def same(near, far, y_moves=True, slopes=(1, 2), tol=1e-7):
    """Slopes, errors and the covariance of slopes agree; the constant follows."""
    k = list(slopes)
    np.testing.assert_allclose(far.params[k], near.params[k], rtol=tol, atol=tol)
    np.testing.assert_allclose(far.cov[np.ix_(k, k)], near.cov[np.ix_(k, k)], rtol=100 * tol, atol=1e-12)
    if "Intercept" in far.names:
        at = far.names.index("x"), far.names.index("x2")
        moved = near.params[0] + (MEAN if y_moves else 0) - MEAN * near.params[at[0]] + MEAN * near.params[at[1]]
        assert abs(far.params[0] - moved) < 1e-6 * MEAN
    assert far.stats.get("dropped", []) == []


X = [num("x"), num("x2")]
FITS = {
    "ols": lambda d: linear.ols(d, Design(["y"], X), "HC1"),
    "ols_cluster": lambda d: linear.ols(d, Design(["y"], [*X, cat("kind")]), "CLUSTER", ["g"]),
    "iv": lambda d: linear.iv_2sls(d, Design(["y"], X, instruments=[num("z"), num("x2")]), "HC1"),
    "ridge": lambda d: linear.ridge(d, Design(["y"], X), 5.0),
    "ridge_scaled": lambda d: linear.ridge(d, Design(["y"], X), 0.1, normalize=True),
    "fgls": lambda d: linear.fgls(d, Design(["y"], X), 2),
    "elastic_net": lambda d: penalized.elastic_net(d, Design(["y"], X), 0.1, 0.5),
    "rlm": lambda d: irls.rlm(d, Design(["y"], X), cov_type="SANDWICH"),
    "gmm": lambda d: moments_fits.gmm_iv_linear(d, Design(["y"], X, instruments=[num("z"), num("x2"), num("g")])),
    "bootstrap": lambda d: resample.bootstrap(d, Design(["y"], X), ["id"], 20)[0],
    "gaussian_glm": lambda d: irls.glm(d, Design(["y"], X), "gaussian", cov_type="HC1"),
}


@pytest.mark.parametrize("name", FITS)
def test_far_means(tables, name):
    near, far = map(FITS[name], tables)
    same(near, far)


@pytest.mark.parametrize("name", ["logit", "poisson", "mle_poisson", "mle_nb2"])
def test_far_means_of_nonlinear_fits(tables, name):
    run = {
        "logit": lambda d: irls.glm(d, Design(["b"], X), "binomial", cov_type="HC1"),
        "poisson": lambda d: irls.glm(d, Design(["c"], X), "poisson"),
        "mle_poisson": lambda d: mle.fit_mle(d, Design(["c"], X), "poisson"),
        "mle_nb2": lambda d: mle.fit_mle(d, Design(["c"], X), "nb2"),
    }[name]
    near, far = map(run, tables)
    same(near, far, y_moves=False, tol=1e-5 if name == "mle_nb2" else 1e-7)
    if name == "logit":
        for kind in ("dydx", "dyex"):
            a, b = (irls.marginal_effects(f, d, ["x"], kind)["x"] for f, d in zip((near, far), tables, strict=True))
            if kind == "dydx":
                np.testing.assert_allclose(a, b, rtol=1e-6)
        fit, draws = irls.glm_bootstrap(far, tables[1], ["id"], 10)
        other, _ = irls.glm_bootstrap(near, tables[0], ["id"], 10)
        np.testing.assert_allclose(fit.cov[1:, 1:], other.cov[1:, 1:], rtol=1e-5)


def test_far_means_of_quantiles_sure_pls(tables):
    near, far = (irls.quantile_regression(d, Design(["y"], X), [0.3])[0.3] for d in tables)
    np.testing.assert_allclose(far.params[1:], near.params[1:], rtol=1e-3)
    assert far.stats["converged"]
    two = lambda d: linear.sure(d, {"a": Design(["y"], X), "b": Design(["c"], X)}, "g")
    near, far = map(two, tables)
    np.testing.assert_allclose(far.params[[1, 2, 4, 5]], near.params[[1, 2, 4, 5]], rtol=1e-7)
    np.testing.assert_allclose(far.bse[[1, 2, 4, 5]], near.bse[[1, 2, 4, 5]], rtol=1e-6)
    near, far = (moments_fits.pls(d, ["y"], ["x", "x2"], 2) for d in tables)
    np.testing.assert_allclose(far["coef"], near["coef"], rtol=1e-8)
    near, far = (penalized.cross_validate(d, Design(["y"], X), [0.1, 1.0], 3, ["id"]).collect() for d in tables)
    np.testing.assert_allclose([r.mse for r in near], [r.mse for r in far], rtol=1e-8)


def test_first_rows_far_from_the_mean(spark):
    """Constants from first rows that lie elsewhere are found out, and the sums taken again."""
    rng = np.random.default_rng(2)
    x = np.concatenate([np.zeros(300), MEAN * 100 + rng.normal(size=20_000)])
    rows = spark.createDataFrame([(float(a), float(2 * a + b)) for a, b in zip(x[300:], rng.normal(size=20_000), strict=True)], "x double, y double").coalesce(1)
    head = spark.createDataFrame([(MEAN * 300, 2 * MEAN * 300)] * 300, "x double, y double").coalesce(1)
    fit = linear.ols(head.limit(0).union(rows), Design(["y"], [num("x")]))
    assert abs(fit.params[1] - 2) < 0.05 and fit.stats["dropped"] == []
    spread = linear.ols(head.union(rows), Design(["y"], [num("x")]))
    assert abs(spread.params[1] - 2) < 1e-6


def test_dropped_columns_are_named(spark):
    rows = spark.range(50).selectExpr("cast(id as double) as x", "cast(2 * id as double) as twice", "1D as one", "cast(id * id as double) as y")
    fit = linear.ols(rows, Design(["y"], [num("x"), num("twice"), num("one")]))
    assert fit.stats["dropped"] == ["twice", "one"]
