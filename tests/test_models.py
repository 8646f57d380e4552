"""Iterative models, resampling, series, smoothers, joins and streams against numpy and each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlake.operators import aggregates, draws, irls, joins, linear, mle, moments_fits, penalized, resample, series, smooth, tables, windows
from gramlake.operators.terms import Design, num
from gramlake.streaming import fits as streams


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    n = 400
    x = rng.normal(size=n)
    return {"id": np.arange(n), "x": x, "b": (rng.random(n) < 1 / (1 + np.exp(-0.5 - x))).astype(float), "c": rng.poisson(np.exp(0.5 + 0.4 * x)).astype(float), "y": 1 + 2 * x + rng.standard_t(3, n), "p": rng.gamma(2, np.exp(0.3 * x)), "g": rng.integers(0, 12, n)}


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame([tuple(float(data[k][i]) if k not in ("id", "g") else int(data[k][i]) for k in data) for i in range(400)], "id long, x double, b double, c double, y double, p double, g int").repartition(3).persist()


def test_glm(frame, data):
    x = np.stack([np.ones(400), data["x"]], 1)
    fit = irls.glm(frame, Design(["b"], [num("x")]), "binomial")
    mu = 1 / (1 + np.exp(-x @ fit.params))
    assert np.abs(x.T @ (data["b"] - mu)).max() < 1e-6
    assert np.allclose(fit.cov, np.linalg.inv(x.T @ (x * (mu * (1 - mu))[:, None])))
    for link in ("probit", "cloglog", "cauchy"):
        assert irls.glm(frame, Design(["b"], [num("x")]), "binomial", link).stats["llf"] == pytest.approx(fit.stats["llf"], rel=0.05)
    poisson, full = irls.glm(frame, Design(["c"], [num("x")]), "poisson"), mle.fit_mle(frame, Design(["c"], [num("x")]), "poisson")
    assert np.allclose(poisson.params, full.params, atol=1e-5) and poisson.stats["llf"] == pytest.approx(full.stats["llf"])
    assert np.allclose(irls.glm(frame, Design(["y"], [num("x")]), "gaussian").params, linear.ols(frame, Design(["y"], [num("x")])).params)
    gamma = irls.glm(frame, Design(["p"], [num("x")]), "gamma", "log")
    assert np.allclose(gamma.params, mle.fit_mle(frame, Design(["p"], [num("x")]), "gamma").params[:2], atol=1e-4)
    ztp = irls.glm(frame.where("c > 0"), Design(["c"], [num("x")]), "zero_truncated_poisson")
    assert np.allclose(ztp.params, mle.fit_mle(frame.where("c > 0"), Design(["c"], [num("x")]), "zt_poisson").params, atol=1e-4)
    with pytest.raises(ValueError):
        irls.glm(frame, Design(["y"], [num("x")]), "poisson")
    mean = irls.predict(fit, frame).agg(F.avg("mu")).first()[0]
    assert mean == pytest.approx(data["b"].mean())


def test_robust_and_quantile(frame, data):
    x, y = np.stack([np.ones(400), data["x"]], 1), data["y"]
    for norm in ("HuberT", "TukeyBiweight"):
        fit = irls.rlm(frame, Design(["y"], [num("x")]), norm)
        r = y - x @ fit.params
        assert fit.stats["scale"] == pytest.approx(np.median(np.abs(r)) / 0.6744897501960817, rel=1e-3)
        w = irls._psi(norm, r / fit.stats["scale"])[1]
        assert np.abs(x.T @ (w * r)).max() < 0.05
    fits = irls.quantile_regression(frame, Design(["y"], [num("x")]), [0.25, 0.5])
    for tau, f in fits.items():
        cost = lambda b, t=tau: (lambda r: (r * (t - (r < 0))).sum())(y - x @ b)
        best = min(cost(f.params + d) for d in np.random.default_rng(0).normal(scale=0.02, size=(4000, 2)))
        assert cost(f.params) < best * (1 + 1e-4)
        assert abs(f.stats["share_below"] - tau) < 0.02


def test_penalized(frame):
    d = frame.withColumn("z", F.col("x") * F.col("x"))
    design = Design(["y"], [num("x"), num("z")])
    fit = penalized.elastic_net(d, design, 0.3, 0.7)
    assert abs(fit.stats["duality_gap"]) < 1e-8
    assert np.allclose(penalized.elastic_net(d, design, 0.0).params, linear.ols(d, design).params, atol=1e-6)
    ridge = linear.ridge(d, design, 400 * 0.3)
    assert np.allclose(penalized.elastic_net(d, design, 0.3, 0.0).params, ridge.params, atol=1e-6)
    table = penalized.cross_validate(d, design, [0.01, 5.0], 4, ["id"]).collect()
    assert table[0].mse < table[1].mse


def test_moments_and_least_squares(frame, data):
    z = frame.withColumn("v", F.col("x") + F.col("c") / 10)
    iv = linear.iv_2sls(z, Design(["y"], [num("x")], instruments=[num("v")]))
    assert np.allclose(moments_fits.gmm_iv_linear(z, Design(["y"], [num("x")], instruments=[num("v")])).params, iv.params)
    fit = moments_fits.nlls(frame, "y", ["x"], lambda c, t: t[0] + t[1] * c["x"], np.zeros(2))
    ols = linear.ols(frame, Design(["y"], [num("x")]))
    assert np.allclose(fit.params, ols.params, atol=1e-5) and np.allclose(fit.cov, ols.cov, rtol=1e-3)
    bounded = moments_fits.nlls(frame, "y", ["x"], lambda c, t: t[0] + t[1] * c["x"], np.zeros(2), bounds=(np.array([-9, -9]), np.array([9, 1.5])))
    assert bounded.params[1] == 1.5 and np.isnan(bounded.cov).all()
    both = moments_fits.pls(frame.withColumn("z", F.col("x") + F.col("c")), ["y"], ["x", "z"], 2)
    assert np.allclose(both["coef"][:, 0], linear.ols(frame.withColumn("z", F.col("x") + F.col("c")), Design(["y"], [num("x"), num("z")])).params[1:])


def test_counts(frame, data, spark):
    nb = mle.fit_mle(frame, Design(["c"], [num("x")]), "nb2")
    assert nb.names[-1] == "log_alpha" and nb.stats["llf"] >= mle.fit_mle(frame, Design(["c"], [num("x")]), "poisson").stats["llf"] - 0.01
    rng = np.random.default_rng(5)
    zero = spark.createDataFrame([(float(a), float(0 if rng.random() < 0.3 else rng.poisson(math.exp(1 + 0.5 * a)))) for a in rng.normal(size=1500)], "x double, n double")
    zip_ = mle.fit_mle(zero, Design(["n"], [num("x")]), "zip")
    assert np.allclose(zip_.params, [1, 0.5, math.log(0.3 / 0.7)], atol=0.2)
    parts = mle.hurdle(zero, "n", [num("x")], "zt_poisson")
    mean = mle.hurdle_mean(parts, zero).agg(F.avg("mean"), F.avg("n")).first()
    assert mean[0] == pytest.approx(mean[1], rel=0.03)
    with pytest.raises(ValueError):
        mle.fit_mle(frame, Design(["y"], [num("x")]), "poisson")
    with pytest.raises(ValueError):
        mle.hurdle(frame, "p", [num("x")], "gamma")


def test_bootstraps(frame):
    design = Design(["y"], [num("x")])
    hc = linear.ols(frame, design, "HC0").bse
    for kind in ("bayesian", "classical"):
        a, d1 = resample.bootstrap(frame, design, ["id"], 400, kind)
        b, d2 = resample.bootstrap(frame.repartition(7), design, ["id"], 400, kind)
        assert np.allclose(d1, d2) and np.allclose(a.bse, hc, rtol=0.2)
    block, _ = resample.bootstrap(frame, design, [], 300, cluster="g")
    assert np.allclose(block.bse, linear.ols(frame, design, "CLUSTER", ["g"]).bse, rtol=0.5)
    t = resample.permutation_test(frame.withColumn("t", F.col("b")), "y", "t", ["id"], "g", 6).collect()
    assert len(t) == 7 and len({round(r.effect, 9) for r in t}) == 7


def test_series(spark):
    rng = np.random.default_rng(2)
    rows, raw = [], {}
    for k in range(3):
        x = np.zeros(300)
        for i in range(1, 300):
            x[i] = 0.6 * x[i - 1] + rng.normal()
        raw[k] = x
        rows += [(k, i, float(v)) for i, v in enumerate(x)]
    rows += [(9, i, 5.0) for i in range(4)]
    df = spark.createDataFrame(rows, "k int, t long, v double")
    for r in series.acf(df, "v", ["k"], ["t"], 3).collect():
        if r.k == 9:
            assert r.acf == [1, 0, 0, 0]
        else:
            c = raw[r.k] - raw[r.k].mean()
            assert np.allclose(r.acf, [(c[i:] @ c[: 300 - i]) / (c @ c) for i in range(4)])
    for r in series.ar_burg(df, "v", ["k"], ["t"], 1).where("k < 9").collect():
        assert abs(r.ar[0] - 0.6) < 0.15
    mle_ = {r.k: r.ar[0] for r in series.ar_mle(df, "v", ["k"], ["t"], 1).where("k < 9").collect()}
    yw = {r.k: r.ar[0] for r in series.ar_yule_walker(df, "v", ["k"], ["t"], 1).where("k < 9").collect()}
    assert all(abs(mle_[k] - yw[k]) < 0.05 for k in mle_)
    phi = np.array([0.5, -0.3, 0.1])
    assert np.allclose(series.pacf_to_ar(series.ar_to_pacf(phi)), phi)
    f = series.forecast(df, "v", ["k"], ["t"], 1, 4, d=1).where("k = 0").orderBy("step").collect()
    assert [r.step for r in f] == [1, 2, 3, 4] and all(a.variance < b.variance for a, b in zip(f, f[1:], strict=False))
    s = spark.createDataFrame([(0, i, float(10 * math.sin(i * math.pi / 6) + i / 10)) for i in range(144)], "k int, t long, v double")
    parts = series.stl(s, "v", ["k"], ["t"], [12], twindow=25).collect()
    assert max(abs(r.resid) for r in parts[12:-12]) < 1.5
    wide = windows.difference(df, "v", ["k"], ["t"], 1, 1, 2).where("k = 0").orderBy("t").collect()
    d1 = np.diff(raw[0])
    assert np.allclose([r.v for r in wide], d1[2:] - d1[:-2])
    index = windows.global_index(df, ["k", "t"], "i").orderBy("k", "t").collect()
    assert [r.i for r in index] == list(range(904))


def test_smoothers(frame, data):
    x, y = data["x"], data["y"]
    direct = smooth.kernel_smooth_direct(frame, "x", "y", [0.0, 1.0], 0.5).collect()
    for r in direct:
        k = np.exp(-0.5 * ((x - r.x) / 0.5) ** 2)
        assert r.y == pytest.approx((k @ y) / k.sum())
    binned = {round(r.x, 6): r.y for r in smooth.kernel_smooth(frame, "x", "y", 512, 0.5).collect()}
    near = min(binned, key=lambda v: abs(v))
    k = np.exp(-0.5 * ((x - near) / 0.5) ** 2)
    assert binned[near] == pytest.approx((k @ y) / k.sum(), abs=0.02)
    for kind in ("gaussian", "epanechnikov", "tricube"):
        d = smooth.kde(frame, "x", kind, gridsize=256).orderBy("x").collect()
        step = d[1].x - d[0].x
        assert sum(r.density for r in d) * step == pytest.approx(1)
    low = smooth.lowess(frame, "x", "y", [-1.0, 0.0, 1.0], 0.5).collect()
    for r in low:
        dist = np.abs(x - r.x)
        h = np.sort(dist)[199] * 1.005
        w = np.clip(1 - (dist / h) ** 3, 0, None) ** 3
        m = np.stack([np.ones(400), x - r.x], 1)
        assert r.y == pytest.approx(np.linalg.solve(m.T @ (m * w[:, None]), m.T @ (w * y))[0], abs=1e-3)


def test_aggregates_and_joins(spark, frame, data):
    assert aggregates.exact_quantile(frame, F.col("x"), 0.3, keep=10) == pytest.approx(np.quantile(data["x"], 0.3))
    h = aggregates.histogram(frame, "x", -1.0, 1.0, 4, by=["g"]).groupBy("g").agg(F.sum("count").alias("n"), F.count("*").alias("b")).collect()
    assert sum(r.n for r in h) == 400 and {r.b for r in h} == {4}
    lo, hi = aggregates.hdi(frame, "x", 0.9).first()
    assert hi - lo <= np.quantile(data["x"], 0.95) - np.quantile(data["x"], 0.05) + 1e-9
    knots = spark.createDataFrame([(float(i), float(i * i)) for i in range(-5, 6)], "kx double, ky double")
    for kind in ("previous", "next", "nearest", "linear"):
        small = {r.id: r.v for r in joins.interpolate(frame.select("id", "x"), "x", knots, "kx", "ky", kind, "v").collect()}
        large = {r.id: r.v for r in joins._large(frame.select("id", "x"), "x", knots, "kx", "ky", kind, "v").collect()}
        assert small.keys() == large.keys() and all(small[i] == pytest.approx(large[i]) for i in small)
    curve = joins.spline_eval(frame.select("id", "x"), "x", knots, "kx", "ky", name="v").collect()
    assert all(r.v == pytest.approx(r.x**2, abs=1e-6) for r in curve)
    slope = joins.spline_eval(frame.select("id", "x"), "x", knots, "kx", "ky", derivative=1, name="v").collect()
    assert all(r.v == pytest.approx(2 * r.x, abs=1e-6) for r in slope)
    t = spark.createDataFrame([(i, p) for i, p in enumerate([0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.9])], "id long, p double")
    got = {r.id: (r.bh_flag, r.bh_reject) for r in tables.benjamini_hochberg(t, "p").collect()}
    assert [got[i][1] for i in range(7)] == [True, True, False, False, False, False, False]
    assert tables.sample_rows(frame, 10, ["id"]).count() == 10
    batches = frame.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("m2"))
    m = aggregates.merge_moments(batches).first()
    assert m.mean == pytest.approx(data["x"].mean()) and m.m2 == pytest.approx(data["x"].var() * 400)


def test_draws(spark):
    rng = np.random.default_rng(3)
    rows = [(c, i, "a", float(rng.normal())) for c in range(4) for i in range(400)]
    d = spark.createDataFrame(rows, "chain int, draw long, param string, value double")
    assert draws.rhat(d).first().rhat == pytest.approx(1, abs=0.02)
    assert 800 < draws.ess_batch_means(d, [0.5]).first().ess < 3500
    assert all(abs(r.z) < 4 for r in draws.geweke(d).collect())
    assert draws.draws_summary(d, 100, 3).first().n == 400


def test_streams(spark, frame, tmp_path):
    frame.select("x", "y").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.streaming_gram(stream, "y", ["x"], str(tmp_path / "state"), str(tmp_path / "log")).awaitTermination()
    assert np.allclose(streams.running_fit(spark, str(tmp_path / "state"), 2), linear.ols(frame, Design(["y"], [num("x")])).params)
    events = frame.withColumn("ts", F.timestamp_seconds(F.col("id") * 60))
    events.select("ts", "x", "y", "g").write.parquet(str(tmp_path / "events"))
    live = spark.readStream.schema("ts timestamp, x double, y double, g int").parquet(str(tmp_path / "events"))
    q = streams.windowed_fit(live, "ts", "y", "x", [], "1 hour").writeStream.format("memory").queryName("fits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    table = {r.window_start: r.slope for r in streams.windowed_fit(events, "ts", "y", "x", [], "1 hour").collect()}
    got = spark.table("fits").collect()
    assert got and all(r.slope == pytest.approx(table[r.window_start]) for r in got)


def test_registered_queries(spark, sf):
    """A few queries end to end; all of them are compared with SQL by the driver."""
    from gramlake.jobs import registry

    assert registry.flagship(spark, sf).count() == 5
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    for name in ("a1_ols_lineitem", "x2_windowed_fit_events", "t1_acf_events"):
        assert registry.QUERIES[name](spark, sf).count() > 0


def test_one_long_series(spark):
    """Blocks with a halo give what one window over everything gives; whitening recovers the errors' autoregression."""
    from gramlake.operators import covariance

    rng = np.random.default_rng(4)
    e = np.zeros(500)
    for i in range(1, 500):
        e[i] = 0.5 * e[i - 1] + rng.normal()
    x = rng.normal(size=500)
    y = 1 + 2 * x + e
    df = spark.createDataFrame([(0, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "k int, t long, x double, y double").repartition(5)
    fit = linear.ols(df, Design(["y"], [num("x")]))
    whole = covariance.hac_panel(df, fit, ["k"], ["t"], ["x"], "y", lags=4)
    assert np.allclose(covariance.hac_series(df, fit, ["t"], ["x"], "y", lags=4, block=37), whole)
    for keep in (True, False):
        r = series.glsar(df, "y", ["x"], ["k"], ["t"], 1, keep_first=keep)
        assert abs(r["rho"][0] - 0.5) < 0.12 and np.allclose(r["fit"].params, [1, 2], atol=0.3)
    assert np.allclose(series._stationary(np.array([0.5])), 1 / (1 - 0.25))
    hat = linear.leverage(fit, df).agg(F.sum("leverage")).first()[0]
    assert hat == pytest.approx(2)


def test_relative_effects(frame):
    fit = linear.ols(frame, Design(["y"], [num("b"), num("x")]))
    mean = frame.agg(F.avg("x")).first()[0]
    r = linear.lift(fit, "b", {"x": mean})
    assert r["value"] == pytest.approx(fit.params[1] / (fit.params[0] + fit.params[2] * mean)) and r["std_err"] > 0
    w = irls.row_weights(irls.rlm(frame, Design(["y"], [num("x")])), frame, "HuberT").agg(F.min("weight"), F.max("weight")).first()
    assert 0 < w[0] < 1 and w[1] == 1
    zero = mle.predict_zero(mle.fit_mle(frame, Design(["c"], [num("x")]), "poisson"), frame).agg(F.avg("p_zero"), F.avg((F.col("c") == 0).cast("double"))).first()
    assert zero[0] == pytest.approx(zero[1], abs=0.06)
    q = irls.quantile_control_function(frame.withColumn("v", F.col("x") + F.col("g") / 10), Design(["y"], [num("x")], instruments=[num("v")]), "x", [0.5])[0.5]
    assert abs(q.params[1] - 2) < 0.5
    nonlinear = moments_fits.gmm_iv_nonlinear(frame, "y", ["x"], lambda c, t: t[0] + t[1] * c["x"], ["x"], np.zeros(2))
    assert np.allclose(nonlinear.params, linear.ols(frame, Design(["y"], [num("x")])).params, atol=1e-5)


def test_trends_and_periods(spark):
    rng = np.random.default_rng(4)
    y = np.cumsum(rng.normal(size=60)) + 5
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "k string, t int, v double")
    for trend, powers in series.TRENDS.items():
        r = series.autoreg(df, "v", ["k"], ["t"], [1], trend).first()
        m = np.stack([*([np.ones(59)] if 0 in powers else []), y[:-1], *((np.arange(1, 60) + 1.0) ** p for p in powers if p)], 1)
        want, *_ = np.linalg.lstsq(m, y[1:], rcond=None)
        assert r.coef == pytest.approx(want)
    assert len(series.autoreg(df, "v", ["k"], ["t"], [1], "c", (2, 4)).first().coef) == 5
    assert len(series.autoreg(df, "v", ["k"], ["t"], [1], "n", (4,)).first().coef) == 5
    with pytest.raises(ValueError):
        series.autoreg(df, "v", ["k"], ["t"], [1], "cttt")


def test_decomposition_follows_its_steps(spark):
    rng = np.random.default_rng(6)
    t = np.arange(72)
    y = 4 * np.sin(2 * np.pi * t / 12) + 0.15 * t + rng.normal(size=72)
    y[30] += 40
    df = spark.createDataFrame([("a", int(i), float(v)) for i, v in zip(t, y, strict=True)], "k string, t int, v double")
    got = series.stl(df, "v", ["k"], ["t"], [12]).orderBy("t").toPandas()
    season, w = np.zeros(72), None
    for outer in range(2):
        for _ in range(3):
            trend = series.loess(y - season, 19, w)
            season = np.array([np.median((y - trend)[i % 12 :: 12]) for i in t])
        r = np.abs(y - trend - season)
        w = np.clip(1 - (r / (6 * np.median(r))) ** 2, 0, 1) ** 2 if not outer else w
    assert got["trend"].to_numpy() == pytest.approx(trend) and got["seasonal_12"].to_numpy() == pytest.approx(season)
    assert abs(got["resid"][30]) > 30


def test_robust_covariances(frame, data):
    """All four kinds from their formulas."""
    x = np.stack([np.ones(400), data["x"]], 1)
    for kind in ("H1", "H2", "H3", "SANDWICH"):
        fit = irls.rlm(frame, Design(["y"], [num("x")]), "HuberT", kind)
        s = fit.stats["scale"]
        z = (data["y"] - x @ fit.params) / s
        psi, d = np.clip(z, -1.345, 1.345), (np.abs(z) <= 1.345).astype(float)
        m, inv, w = d.mean(), np.linalg.inv(x.T @ x), np.linalg.inv(x.T @ (x * d[:, None]))
        k = 1 + 2 / 400 * d.var() / m**2
        p2 = (psi**2).sum() * s * s / 398
        want = {"H1": k**2 * p2 / m**2 * inv, "H2": k * p2 / m * w, "H3": p2 / k * w @ x.T @ x @ w, "SANDWICH": w @ (x * (psi * psi)[:, None]).T @ x @ w * s * s * 400 / 398}[kind]
        assert fit.cov == pytest.approx(want, rel=1e-6)


def test_effects_and_bootstrap_of_a_logit(frame, data):
    fit = irls.glm(frame, Design(["b"], [num("x")]), "binomial")
    for at, x in (("mean", data["x"].mean()), ("median", np.median(data["x"]))):
        mu = 1 / (1 + np.exp(-fit.params @ [1, x]))
        v = mu * (1 - mu)
        effect, se = irls.marginal_effects(fit, frame, ["x"], at=at)["x"]
        j = np.array([v * (1 - 2 * mu) * fit.params[1], v * (1 - 2 * mu) * x * fit.params[1] + v])
        assert effect == pytest.approx(v * fit.params[1]) and se == pytest.approx(math.sqrt(j @ fit.cov @ j), rel=1e-5)
    robust = irls.glm(frame, Design(["b"], [num("x")]), "binomial", cov_type="HC1")
    for kind in ("bayesian", "classical"):
        boot, draws = irls.glm_bootstrap(fit, frame, ["id"], 800, kind)
        assert boot.bse == pytest.approx(robust.bse, rel=0.15) and draws.shape == (800, 2)
        assert (irls.glm_bootstrap(fit, frame.repartition(5), ["id"], 800, kind)[1] == pytest.approx(draws))


def test_splines_solve_in_one_sweep():
    rng = np.random.default_rng(8)
    x = np.sort(rng.uniform(0, 10, 40))
    y = rng.normal(size=40)
    h = np.diff(x)
    for bc in ("natural", "clamped", "not-a-knot"):
        a, b, c, d = joins.spline_coefficients(x, y, bc).T
        end = a + h * (b + h * (c + h * d)), b + h * (2 * c + 3 * h * d), 2 * c + 6 * h * d
        assert end[0] == pytest.approx(y[1:]) and end[1][:-1] == pytest.approx(b[1:]) and end[2][:-1] == pytest.approx(2 * c[1:], abs=1e-8)
        if bc == "natural":
            assert abs(c[0]) < 1e-12 and abs(end[2][-1]) < 1e-8
        elif bc == "clamped":
            assert abs(b[0]) < 1e-10 and abs(end[1][-1]) < 1e-8
        else:
            assert d[0] == pytest.approx(d[1]) and d[-1] == pytest.approx(d[-2])


def test_equal_p_values_rank_by_the_other_columns(spark):
    """Ranks of ties don't depend on how rows are dealt."""
    for by in ([], ["g"]):
        for parts in (1, 5):
            t = spark.range(60, numPartitions=parts).selectExpr("(id * 37) % 60 as id", "1 as g", "cast(0.01 as double) * (id * 37 % 60 % 3) as p").repartition(parts)
            got = {r.id: r.bh_rank for r in tables.benjamini_hochberg(t, "p", by=by).collect()}
            assert got == {i: i % 3 * 20 + i // 3 + 1 for i in range(60)}


def test_cached_rows_use_all_cores(spark):
    """Rows that a join left in one partition are dealt to all cores before a fit passes over them; few rows stay."""
    from gramlake.operators.state import held

    cores = spark.sparkContext.defaultParallelism
    rows = held(spark.range(0, 40_000, 1, 1).selectExpr("cast(id as double) as y0"))
    parts = rows.select(F.spark_partition_id().alias("p"), "y0").groupBy("p").agg(F.count("*").alias("n"), F.sum("y0").alias("s")).collect()
    assert len(parts) >= cores and max(r.n for r in parts) < 10_000 and sum(r.s for r in parts) == 40_000 * 39_999 / 2
    rows.unpersist()
    few = held(spark.range(0, 100, 1, 1).selectExpr("cast(id as double) as y0"))
    assert few.select(F.spark_partition_id().alias("p")).distinct().count() == 1 and held(few.limit(0)).count() == 0


def test_one_robust_fit_has_all_covariances(spark):
    """A fit's covariances of all kinds are those of fits asked for each."""
    rows = spark.range(0, 300, 1, 2).selectExpr("cast(id as double) as x", "2D * id + 50 * sin(id * id) + if(id % 17 = 0, 400, 0) as y")
    design = Design(["y"], [num("x")])
    fit = irls.rlm(rows, design)
    assert set(fit.covariances) == {"H1", "H2", "H3", "SANDWICH"} and np.array_equal(fit.covariances["H1"], fit.cov)
    assert np.allclose(fit.covariances["SANDWICH"], irls.rlm(rows, design, cov_type="SANDWICH").cov, rtol=1e-9)
