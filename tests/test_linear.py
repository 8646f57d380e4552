"""Linear models, designs and covariances against plain numpy, and the equivalences between estimators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlake.functions import special
from gramlake.operators import covariance, linear
from gramlake.operators.terms import Design, bs, cat, cheb, center, null_report, num, poly, seasonal, standardize, trend


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        x, z, g, h = float(rng.normal()), float(rng.normal()), f"g{rng.integers(0, 8)}", int(rng.integers(0, 5))
        rows.append((i, x, z, g, h, float(rng.uniform(0.5, 2)), 1 + 2 * x - z + len(g) + h + float(rng.normal())))
    rows += [(300, None, 1.0, "g1", 1, 1.0, 2.0), (301, 1.0, 1.0, None, 1, 1.0, 2.0), (302, 1.0, 1.0, "g1", 1, -1.0, 2.0), (303, math.nan, 1.0, "g1", 1, 1.0, 2.0), (304, 1.0, math.inf, "g1", 1, 0.0, None)]
    return spark.createDataFrame(rows, "id long, x double, z double, g string, h int, w double, y double")


def arrays(frame, weights=False):
    rows = [r for r in frame.collect() if r.id < 300]
    x = np.array([[1.0, r.x, r.z] for r in rows])
    return x, np.array([r.y for r in rows]), np.array([r.w for r in rows]) if weights else np.ones(len(rows)), rows


@pytest.mark.parametrize("partitions", [1, 7, 64])
@pytest.mark.parametrize("weights", [None, "w"])
def test_least_squares(frame, partitions, weights):
    clean = frame.where("g is not null").repartition(partitions)
    fit = linear.ols(clean, Design(["y"], [num("x"), num("z")], weights=weights))
    x, y, w, rows = arrays(frame, bool(weights))
    if not weights:  # rows 302 is valid without weights
        x, y, w = np.vstack([x, [1, 1, 1]]), np.append(y, 2.0), np.append(w, 1)
    beta = np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (y * w))
    e = y - x @ beta
    assert np.allclose(fit.params, beta)
    assert np.allclose(fit.cov, np.linalg.inv(x.T @ (x * w[:, None])) * (w * e * e).sum() / (len(y) - 3))
    for kind in ("HC0", "HC1", "HC2", "HC3"):
        bread = np.linalg.inv(x.T @ (x * w[:, None]))
        h = w * np.einsum("ij,jk,ik->i", x, bread, x)
        s = x * (w * e / {"HC2": np.sqrt(1 - h), "HC3": 1 - h}.get(kind, 1))[:, None]
        want = bread @ s.T @ s @ bread * (len(y) / (len(y) - 3) if kind == "HC1" else 1)
        assert np.allclose(linear.ols(clean, Design(["y"], [num("x"), num("z")], weights=weights), kind).cov, want)


def test_dummies_equal_absorbed(frame):
    clean = frame.where("id < 300")
    dummies = linear.ols(clean, Design(["y"], [num("x"), num("z"), cat("g", "h")]))
    absorbed = linear.absorb_ols(clean, Design(["y"], [num("x"), num("z")]), ["g", "h"])
    assert np.allclose(dummies.params[1:3], absorbed.params)
    assert np.allclose(dummies.bse[1:3], absorbed.bse)
    within = linear.demean(clean, Design(["y"], [num("x"), num("z")]), ["g", "h"])
    again = linear.ols(within, Design(["y0"], [num("x0"), num("x1")], intercept=False))
    assert np.allclose(again.params, absorbed.params)


def test_clusters(frame):
    clean = frame.where("id < 300")
    x, y, _, rows = arrays(frame)
    beta = np.linalg.solve(x.T @ x, x.T @ y)
    s, bread, total = x * (y - x @ beta)[:, None], np.linalg.inv(x.T @ x), np.zeros((3, 3))
    for keys, sign in (([r.g for r in rows], 1), ([r.h for r in rows], 1), ([(r.g, r.h) for r in rows], -1)):
        sums = {}
        for k, v in zip(keys, s, strict=True):
            sums[k] = sums.get(k, 0) + v
        m = sum(np.outer(v, v) for v in sums.values())
        total += sign * m * 299 / 297 * len(sums) / (len(sums) - 1)
    fit = linear.ols(clean, Design(["y"], [num("x"), num("z")]), "CLUSTER", ["g", "h"])
    assert np.allclose(fit.cov, bread @ total @ bread)
    assert fit.df_resid == 4
    with pytest.raises(ValueError):
        linear.ols(clean.where("h = 1"), Design(["y"], [num("x")]), "CLUSTER", ["h"])


def test_edges(spark, frame):
    design = Design(["y"], [num("x"), num("z")])
    empty = linear.ols(frame.limit(0), design)
    assert empty.stats["n"] == 0 and not empty.params.any()
    double = frame.where("id < 300").withColumn("x2", F.col("x") * 2).withColumn("k", F.lit(3.0))
    fit = linear.ols(double, Design(["y"], [num("x"), num("x2"), num("k"), num("z")]))
    assert fit.params[2] == 0 and fit.params[3] == 0  # dependent on x, and on the constant
    assert np.allclose(fit.params[[0, 1, 4]], linear.ols(double, design).params)
    perfect = linear.ols(double.withColumn("p", 1 + 2 * F.col("x")), Design(["p"], [num("x")]))
    assert np.allclose(perfect.params, [1, 2]) and perfect.stats["r2"] == pytest.approx(1)
    r = null_report(frame, Design(["y"], [num("x"), cat("g")], weights="w")).first()
    assert (r.n_rows, r.invalid_y, r.invalid_x, r.invalid_weights) == (305, 1, 3, 2)
    assert r.invalid_any == 5


def test_terms(frame):
    clean = frame.where("id < 300")
    x, y, _, rows = arrays(frame)
    t = np.arange(300)
    designs = {
        "poly": ([poly("x", 3)], np.stack([x[:, 1] ** p for p in range(4)], 1)),
        "cheb": ([cheb("x", 3)], np.stack([x[:, 1] ** p for p in range(4)], 1)),
        "center": ([center("x"), standardize("z")], x),
        "slopes": ([num("x") * cat("h")], np.stack([np.ones(300)] + [x[:, 1] * (np.array([r.h for r in rows]) == k) for k in range(5)], 1)),
        "time": ([trend("id", [1, 2]), seasonal("id", [2, 4])], np.stack([np.ones(300), t, t**2.0, t % 4 == 1, t % 4 == 2, t % 4 == 3], 1).astype(float)),
    }
    for name, (terms, m) in designs.items():
        fit = linear.ols(clean, Design(["y"], terms))
        best = np.linalg.lstsq(m, y, rcond=None)[0]
        assert fit.stats["ssr"] == pytest.approx(((y - m @ best) ** 2).sum(), rel=1e-7), name
        assert np.allclose(sorted(r.f for r in fit.plan.predictions(clean, fit.params, "f").select("f").collect()), sorted(m @ best), atol=1e-6), name
    spline = bs("x", 5).fit(clean)
    b = np.array([r.b for r in clean.select(F.array(*spline.columns).alias("b")).collect()])
    assert b.shape == (300, 5) and (b >= -1e-12).all() and (b.sum(1) <= 1 + 1e-9).all()


def test_instruments_ridge_many(frame):
    clean = frame.where("id < 300").withColumn("v", F.col("z") + 0.5 * F.col("x"))
    x, y, _, rows = arrays(frame)
    z = np.stack([np.ones(300), x[:, 2] + 0.5 * x[:, 1], np.array([float(r.h) for r in rows])], 1)
    xx = x[:, :2]
    hat = z @ np.linalg.lstsq(z, xx, rcond=None)[0]
    fit = linear.iv_2sls(clean, Design(["y"], [num("x")], instruments=[num("v"), num("h")]))
    assert np.allclose(fit.params, np.linalg.lstsq(hat, y, rcond=None)[0])
    r = linear.ridge(clean, Design(["y"], [num("x"), num("z")]), 5.0)
    assert np.allclose(r.params, np.linalg.solve(x.T @ x + np.diag([0, 5, 5]), x.T @ y))
    many = {r.h: r.coef for r in linear.fit_many(clean, ["h"], "y", ["x"]).collect()}
    for h, coef in many.items():
        own = np.array([r.h == h for r in rows])
        assert np.allclose(coef, np.linalg.lstsq(x[own, :2], y[own], rcond=None)[0])
    shares = {r.term: r.value for r in linear.shapley_r2(clean, "y", ["x", "z", "h"]).collect()}
    assert sum(shares.values()) == pytest.approx(linear.ols(clean, Design(["y"], [num("x"), num("z"), num("h")])).stats["r2"])
    sampled = {r.term: r.value for r in linear.shapley_r2(clean, "y", ["x", "z", "h"], samples=200).collect()}
    assert all(abs(sampled[t] - shares[t]) < 0.03 for t in shares)


def test_save_and_load(spark, frame, tmp_path):
    fit = linear.ols(frame, Design(["y"], [num("x"), num("z")]))
    fit.save(str(tmp_path / "fit"), spark)
    back = linear.Fit.load(str(tmp_path / "fit"), spark)
    assert np.allclose(back.params, fit.params) and np.allclose(back.cov, fit.cov) and back.names == fit.names


def test_hac_panel(frame):
    clean = frame.where("id < 300")
    fit = linear.ols(clean, Design(["y"], [num("x")]))
    x, y, _, rows = arrays(frame)
    s = x[:, :2] * (y - x[:, :2] @ fit.params)[:, None]
    m = np.zeros((2, 2))
    for h in range(5):
        own = s[[r.h == h for r in rows]]
        m += own.T @ own
        for lag in (1, 2):
            c = own[lag:].T @ own[:-lag]
            m += (1 - lag / 3) * (c + c.T)
    assert np.allclose(covariance.hac_panel(clean, fit, ["h"], ["id"], ["x"], "y", lags=2), fit.bread @ m @ fit.bread)


def test_special_functions():
    assert special.gammaln(np.array([0.5, 1, 5, 100.5])) == pytest.approx([math.lgamma(v) for v in (0.5, 1, 5, 100.5)])
    assert float(special.t_sf(2.0, 10)) == pytest.approx(0.03669402, abs=1e-7)
    assert float(special.f_sf(3.0, 2, 20)) == pytest.approx(0.07253815, abs=1e-7)
    assert float(special.chi2_sf(5.0, 3)) == pytest.approx(0.17179714, abs=1e-7)
    assert float(special.digamma(1.0)) == pytest.approx(-0.5772156649, abs=1e-9)
    assert float(special.trigamma(1.0)) == pytest.approx(math.pi**2 / 6, abs=1e-9)
    assert special.norm_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert special.t_ppf(0.975, 5) == pytest.approx(2.570581836, abs=1e-6)


def test_sums_far_from_zero(spark):
    """Means that are large against the deviations: as good as numpy on centred columns."""
    rng = np.random.default_rng(3)
    x, z = 1e7 + rng.normal(size=500), -3e6 + rng.normal(size=500)
    y = 5e8 + 0.3 * (x - 1e7) - 0.2 * (z + 3e6) + rng.normal(size=500)
    df = spark.createDataFrame([(float(a), float(b), float(c), i % 7) for i, (a, b, c) in enumerate(zip(x, z, y, strict=True))], "x double, z double, y double, g int").repartition(5)
    u = np.stack([np.ones(500), x - x.mean(), z - z.mean()], 1)
    beta, *_ = np.linalg.lstsq(u, y - y.mean(), rcond=None)
    ssr = ((y - y.mean() - u @ beta) ** 2).sum()
    fit = linear.ols(df, Design(["y"], [num("x"), num("z")]))
    assert fit.params[1:] == pytest.approx(beta[1:], rel=1e-7) and fit.stats["ssr"] == pytest.approx(ssr, rel=1e-7)
    many = linear.fit_many(df, ["g"], "y", ["x", "z"]).collect()
    for r in many:
        own = np.arange(500) % 7 == r.g
        want, *_ = np.linalg.lstsq(np.stack([np.ones(own.sum()), x[own] - 1e7, z[own] + 3e6], 1), y[own] - 5e8, rcond=None)
        assert r.coef[1:] == pytest.approx(want[1:], rel=1e-6)
    within = linear.absorb_ols(df, Design(["y"], [num("x"), num("z")]), ["g"])
    d = np.eye(7)[np.arange(500) % 7]
    want, *_ = np.linalg.lstsq(np.concatenate([d, u[:, 1:]], 1), y - y.mean(), rcond=None)
    assert within.params == pytest.approx(want[7:], rel=1e-7)


def test_polynomial_of_high_degree(spark):
    """Powers up to 5 of numbers far from 0, against an orthogonal basis."""
    x = np.linspace(100, 120, 200)
    y = ((x - 110) / 10) ** 5 + 2 * ((x - 110) / 10) ** 2
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip((x - 110) / 10 + 3, y, strict=True)], "x double, y double")
    fit = linear.ols(df, Design(["y"], [poly("x", 5)]))
    assert fit.stats["r2"] == pytest.approx(1.0, abs=1e-8) and fit.params[-1] == pytest.approx(1.0, rel=1e-4)


def test_dependent_columns_get_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 6))
    x[:, 3] = x[:, 0] + x[:, 1]
    x[:, 5] = 0
    a = x.T @ x
    beta, inverse = linear.solve_scaled(a, a @ np.arange(6.0))
    assert beta[3] == beta[5] == 0 and (inverse[3] == 0).all()
    assert beta[[0, 1, 2, 4]] == pytest.approx([3, 4, 2, 4])
    assert linear.independent(np.eye(300)).tolist() == list(range(300)) and linear.independent(a).tolist() == [0, 1, 2, 4]
    small = linear._sweep(a / np.abs(a).max())
    monkeypatch.setattr(linear, "SMALL", 3)
    assert linear._sweep(a / np.abs(a).max()) == pytest.approx(small, rel=1e-8)


def test_long_sums_come_in_pieces(spark):
    from gramlake.operators import rows

    df = spark.range(1000).select(F.col("id").cast("double").alias("v")).repartition(7)
    n = 2 * rows.PIECE + 5
    got = rows.sum_rows(df, lambda c: np.concatenate([np.full(n - 1, c["v"].sum()), [len(c["v"])]]))
    assert len(got) == n and (got[:-1] == 499500).all() and got[-1] == 1000
    assert len(rows.sum_rows(df.limit(0), lambda c: np.zeros(3))) == 0


@pytest.mark.parametrize("weights", [None, "w"])
def test_levels_equal_dummies(spark, frame, weights):
    """A constant and a slope for each level, and a common slope, against all dummies at once."""
    rows = [r for r in frame.collect() if r.id < 300]
    levels = sorted({r.g for r in rows})
    d = np.array([[float(r.g == v) for v in levels] for r in rows])
    x, z, y = (np.array([getattr(r, c) for r in rows]) for c in "xzy")
    w = np.array([r.w for r in rows]) if weights else np.ones(300)
    m = np.concatenate([d, d * x[:, None], z[:, None]], 1)
    inverse = np.linalg.inv(m.T @ (m * w[:, None]))
    beta = inverse @ (m.T @ (w * y))
    e = y - m @ beta
    se = np.sqrt(np.diag(inverse) * (w * e * e).sum() / (300 - m.shape[1]))
    fit, table = linear.level_ols(frame.where("id < 300"), "y", ["g"], ["x"], ["z"], weights)
    k = len(levels)
    assert fit.params == pytest.approx(beta[-1:]) and fit.bse == pytest.approx(se[-1:])
    got = {r.g: r for r in table.collect()}
    for i, v in enumerate(levels):
        assert got[v].coef == pytest.approx([beta[i], beta[k + i]]) and got[v].std_err == pytest.approx([se[i], se[k + i]])
    empty = linear.level_ols(frame.limit(0), "y", ["g"], x=["z"])
    assert empty[1].count() == 0


def test_absorbed_clusters_on_several_columns(frame):
    """The same errors as of demeaned rows clustered by inclusion and exclusion, whatever the order of the columns."""
    clean = frame.where("g is not null and id < 300").withColumn("c1", F.col("id") % 11).withColumn("c2", F.col("id") % 13)
    design = Design(["y"], [num("x"), num("z")])
    one, two, back = (linear.absorb_ols(clean, design, ["g"], cluster=c) for c in (["c1"], ["c1", "c2"], ["c2", "c1"]))
    assert two.bse == pytest.approx(back.bse) and not np.allclose(one.bse, two.bse) and two.stats["n_clusters"] == 11
    with pytest.raises(ValueError):
        linear.absorb_ols(clean.withColumn("k", F.lit(1)), design, ["g"], cluster=["k"])


def test_scores_of_clusters_add_up_in_tasks_of_bounded_size(spark, monkeypatch):
    rng = np.random.default_rng(21)
    rows = [(i % 7, 0 if i % 3 else i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(3000, 2)))]
    df = spark.createDataFrame(rows, "g long, c long, x double, y double").repartition(2)
    whole = linear.absorb_ols(df, Design(["y"], [num("x")]), ["g"], cluster=["c"])
    sizes, plain = [], covariance.spread
    monkeypatch.setattr(covariance, "SPREAD_ROWS", 200)

    def seen(scores, n):
        out = plain(scores, n)
        sizes.extend(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        return out

    monkeypatch.setattr(covariance, "spread", seen)
    fit = linear.absorb_ols(df, Design(["y"], [num("x")]), ["g"], cluster=["c"])
    assert np.allclose(fit.cov, whole.cov, rtol=1e-10) and fit.stats["n_clusters"] == whole.stats["n_clusters"] == 1000
    assert sum(sizes) == 3000 and len(sizes) == 15 and max(sizes) < 400
    plan = linear.demean(df, Design(["y"], [num("x")]), ["g"], ["c"], 7)._jdf.queryExecution().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
