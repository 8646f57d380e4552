"""Exact quantiles of many groups at once."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlake.operators import aggregates, draws, smooth
from gramlake.operators.terms import Design, bs


@pytest.fixture(scope="module")
def values(spark):
    """A hot group of a third of the rows, heavy tails, ties, one value, a lone row, a null group, and what isn't finite."""
    rng = np.random.default_rng(9)
    groups = {"hot": np.round(rng.normal(size=3000), 2), "tail": np.exp(rng.normal(0, 20, 1500)), "ties": rng.integers(0, 3, 1000).astype(float), "same": np.full(700, 4.25), "one": np.array([2.0]), None: rng.random(900), "two": np.array([-1e300, 1e300])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("hot", None), ("hot", math.nan), ("tail", math.inf), ("none", None)]
    return groups, spark.createDataFrame(rows, "g string, x double").repartition(5)


@pytest.mark.parametrize(("keep", "bins"), [(50_000, 256), (100, 64)])
def test_quantiles_of_groups(values, keep, bins):
    groups, df = values
    shares = [0.0, 0.025, 0.25, 0.5, 2 / 3, 0.975, 1.0]
    got = {r.g: (r.n, r.q) for r in aggregates.quantiles(df, F.col("x"), shares, ["g"], keep, bins).collect()}
    assert set(got) == set(groups)
    for g, v in groups.items():
        assert got[g][0] == len(v)
        np.testing.assert_allclose(got[g][1], np.quantile(v, shares), rtol=1e-12, atol=1e-300)


def test_quantiles_of_all_rows(values, spark):
    groups, df = values
    every = np.concatenate(list(groups.values()))
    r = aggregates.quantiles(df, F.col("x"), [0.1, 0.9], keep=50, bins=32).first()
    assert r.n == len(every) and np.allclose(r.q, np.quantile(every, [0.1, 0.9]))
    assert aggregates.quantiles(df.limit(0), F.col("x"), [0.5]).count() == 0
    assert aggregates.quantiles(df.limit(0), F.col("x"), [0.5], ["g"]).count() == 0


def test_call_sites(values, spark):
    groups, df = values
    hot = df.where("g = 'hot'")
    want = np.quantile(groups["hot"], [0.25, 0.75])
    n, sd = 3000, np.std(groups["hot"], ddof=1)
    assert smooth.bandwidth(hot, "x", rule="silverman") == pytest.approx(0.9 * min(sd, (want[1] - want[0]) / 1.34) * n**-0.2)
    r = draws.draws_summary(df.where("g in ('hot', 'ties')").selectExpr("g as param", "1 as draw", "x as value").where("not isnan(value)")).where("param = 'ties'").first()
    assert (r.n, r.median) == (1000, np.median(groups["ties"]))
    low, high = aggregates.hdi(df.where("g = 'same'"), "x", by=["g"]).select("lo", "hi").first()
    assert low == high == 4.25
    plan = Design([], [bs("x", 5)], intercept=False).fit(hot)
    assert len(plan.names) == 5


def test_joint_effective_size(spark):
    """Independent draws count about as many as they are; one parameter's joint size is its own."""
    rng = np.random.default_rng(17)
    rows = [(c, i, p, float(v)) for c in range(4) for i, pair in enumerate(rng.multivariate_normal([0, 0], [[1, 0.6], [0.6, 2]], 900)) for p, v in zip("ab", pair, strict=True)]
    df = spark.createDataFrame(rows, "chain long, draw long, param string, value double")
    assert 1500 < draws.joint_ess(df, ["a", "b"], [0.4, 0.5]) < 4500
    one = draws.ess_batch_means(df, [0.4, 0.5]).where("param = 'a'").first().ess
    assert draws.joint_ess(df, ["a"], [0.4, 0.5]) == pytest.approx(one)
    assert math.isnan(draws.joint_ess(df.limit(0), ["a", "b"], [0.5]))
