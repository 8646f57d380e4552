"""Permutations of a treatment, against shuffles done row by row from the same hashes."""

import numpy as np
import pytest

from gramlake.operators import linear, resample
from gramlake.operators.terms import Design, cat, num


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    n = 3000
    g = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 40, n))
    t = (rng.random(n) < np.where(g == 0, 0.2, 0.5)).astype(int)
    t[g == 5] = 1
    t[g == 6] = 0
    x, w = rng.normal(1e3, 2, n), rng.random(n) + 0.5
    return {"id": np.arange(n), "g": g, "t": t, "x": x, "w": w, "k": rng.integers(0, 3, n), "y": 0.5 * x + t + 0.2 * g + rng.normal(size=n)}


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(list(zip(*[v.tolist() for v in data.values()], strict=True)), "id long, g long, t int, x double, w double, k long, y double").repartition(6).cache()


def shuffled(data, b, seed):
    """The treatment of permutation b: the rows of the least hashes of each group."""
    if not b:
        return data["t"].astype(float)
    out = np.zeros(len(data["g"]))
    u = resample._mixed(data["id"], np.array([b], np.uint64), seed)[:, 0]
    for g in np.unique(data["g"]):
        at = np.flatnonzero(data["g"] == g)
        out[at[np.argsort(u[at], kind="stable")[: data["t"][at].sum()]]] = 1
    return out


@pytest.mark.parametrize("part", [resample.PART_ROWS, 300, 20])
def test_draws_equal_refits(frame, data, part, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 5000)
    design = Design(["y"], [num("x"), cat("k")], weights="w")
    got = {r.permutation: r.coef for r in resample.permute_coefficient(frame, design, "t", "id", "g", 9, 4, part).collect()}
    x = np.stack([np.ones(len(data["x"])), data["x"] - 1e3, data["k"] == 1, data["k"] == 2], 1)
    root = np.sqrt(data["w"])
    for b in range(10):
        m = np.concatenate([x, shuffled(data, b, 4)[:, None]], 1) * root[:, None]
        assert abs(got[b] - np.linalg.lstsq(m, data["y"] * root, rcond=None)[0][-1]) < 1e-8


def test_observed_is_the_fit(frame):
    got = resample.permute_coefficient(frame, Design(["y"], [num("x")]), "t", ["id"], "g", 3).where("permutation = 0").first().coef
    fit = linear.ols(frame, Design(["y"], [num("x"), num("t")]))
    assert abs(got - fit.params[2]) < 1e-9


def test_equal_keys_and_edges(spark, frame):
    """Rows of equal keys share the places at a threshold; no rows, no variation and null groups have defined results."""
    same = frame.selectExpr("7L as id", "g", "t", "y")
    for part in (10**6, 50):
        got = resample.permute_coefficient(same, Design(["y"], []), "t", "id", "g", 3, part=part).collect()
        assert [r.permutation for r in got] == [0, 1, 2, 3] and all(abs(r.coef) < 1e3 for r in got)
        assert len({round(r.coef, 9) for r in got[1:]}) == 1
    empty = resample.permutation_test(frame.limit(0), "y", "t", "id", "g", 2).collect()
    assert [r.effect for r in empty] == [None] * 3
    assert [r.effect for r in resample.permutation_test(frame.where("t = 1"), "y", "t", "id", "g", 2).collect()] == [None] * 3
    lone = frame.selectExpr("id", "if(g = 3, null, g) as g", "t", "y")
    assert resample.permutation_test(lone, "y", "t", "id", "g", 2).where("permutation = 0").first().effect == pytest.approx(resample.permutation_test(frame.where("g <> 3"), "y", "t", "id", "g", 2).first().effect)


def test_groups_stay_whole_where_a_join_becomes_a_broadcast(spark, monkeypatch):
    """Sizes of groups may turn out small while the query runs, so that they are broadcast and rows stay where they were read: the groups' own shuffle must be in the plan."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "50k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    rows = spark.range(0, 6000, 1, 8).selectExpr("id", "id % 97 as g", "cast(id % 7 < 3 as int) as t", "cast(id * id % 1009 as double) as y")
    id_ = np.arange(6000)
    own = {"id": id_, "g": id_ % 97, "t": (id_ % 7 < 3).astype(int)}
    y = (id_ * id_ % 1009).astype(float)
    plans, add = [], resample.add_pieces
    monkeypatch.setattr(resample, "add_pieces", lambda df, *more, **named: (plans.append(df._jdf.queryExecution().executedPlan().toString()), add(df, *more, **named))[1])
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.permutation: r.effect for r in resample.permutation_test(rows, "y", "t", "id", "g", 4).collect()}
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert "SortMergeJoin" in plans[0] and "REPARTITION_BY_COL" in plans[0]
    for b in range(5):
        s = shuffled(own, b, 0)
        assert got[b] == pytest.approx(np.cov(s, y)[0, 1] / s.var(ddof=1), abs=1e-8)
