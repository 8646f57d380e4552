"""Effects and their errors against closed forms; densities by group."""

import numpy as np
import pytest

from gramlake.operators import effects, irls, mle, smooth
from gramlake.operators.terms import Design, num, poly


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(14)
    n = 2000
    x, t, w = rng.normal(size=n), (rng.random(n) < 0.4).astype(float), rng.random(n) + 0.5
    b = (rng.random(n) < 1 / (1 + np.exp(-0.3 * x - t))).astype(float)
    c = rng.poisson(np.exp(0.1 + 0.3 * x + 0.2 * t)).astype(float)
    return spark.createDataFrame(list(zip(x.tolist(), t.tolist(), b.tolist(), c.tolist(), w.tolist(), (["a", "b", None] * n)[:n], strict=True)), "x double, t double, b double, c double, w double, g string").cache()


def test_row_effects_of_a_dummy(frame):
    """The secant of every row and its error by hand."""
    fit = irls.glm(frame, Design(["b"], [num("x"), num("t")]), "binomial")
    b = fit.params
    for r in effects.row_effects(fit, frame, "t", irls.predict, secant=True).limit(50).collect():
        p = lambda t: 1 / (1 + np.exp(-(b[0] + b[1] * r.x + b[2] * t)))  # noqa: E731, B023
        j = p(1) * (1 - p(1)) * np.array([1, r.x, 1]) - p(0) * (1 - p(0)) * np.array([1, r.x, 0])
        assert r.effect == pytest.approx(p(1) - p(0), rel=1e-9) and r.std_err == pytest.approx(np.sqrt(j @ fit.cov @ j), rel=1e-5)


def test_average_effects(frame):
    fit = mle.fit_mle(frame, Design(["c"], [num("x"), num("t")], weights="w"), "poisson")
    rows = np.array([(r.x, r.t, r.w) for r in frame.collect()])
    m = np.stack([np.ones(len(rows)), rows[:, 0], rows[:, 1]], 1)
    mu, w = np.exp(m @ fit.params), rows[:, 2] / rows[:, 2].sum()
    jac = (w * mu) @ m * fit.params[1] + np.array([0, w @ mu, 0])
    effect, error = mle.average_effect(fit, frame, "x", weight="w")
    assert effect == pytest.approx(w @ mu * fit.params[1], rel=1e-6) and error == pytest.approx(np.sqrt(jac @ fit.cov @ jac), rel=1e-5)
    up, down = (np.exp(m[:, :2] @ fit.params[:2] + fit.params[2] * t) for t in (1, 0))
    assert mle.average_effect(fit, frame, "t", secant=True)[0] == pytest.approx((up - down).mean(), rel=1e-9)
    curved = irls.glm(frame, Design(["b"], [poly("x", 2)]), "binomial")
    assert effects.average_effects(curved, frame, ["x"], irls.predict)["x"][0] != 0
    assert all(np.isnan(mle.average_effect(fit, frame.limit(0), "x")))


def test_densities_by_group(frame):
    """Each group's density is that of the group alone; weights of one change nothing; clips bound the grid."""
    got = {}
    for r in smooth.kde(frame, "x", gridsize=64, by=["g"]).collect():
        got.setdefault(r.g, []).append((r.x, r.density))
    assert set(got) == {"a", "b", None}
    for g in got:
        own = frame.where("g is null" if g is None else f"g = '{g}'")
        alone = sorted((r.x, r.density) for r in smooth.kde(own, "x", gridsize=64).collect())
        np.testing.assert_allclose(sorted(got[g]), alone, rtol=1e-9, atol=1e-12)
    even = sorted((r.x, r.density) for r in smooth.kde(frame.selectExpr("x", "2D as w"), "x", gridsize=64, weight="w").collect())
    np.testing.assert_allclose(even, sorted((r.x, r.density) for r in smooth.kde(frame, "x", gridsize=64).collect()), rtol=1e-9, atol=1e-12)
    cut = smooth.kde(frame, "x", gridsize=64, clip=(-1.0, 1.0)).collect()
    assert min(r.x for r in cut) > -1 and max(r.x for r in cut) < 1 and sum(r.density for r in cut) * 2 / 64 == pytest.approx(1)
    assert smooth.kde(frame.selectExpr("1D as x"), "x").count() == 0
