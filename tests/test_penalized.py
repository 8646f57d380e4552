"""Penalties and targets of single terms."""

import numpy as np
import pytest

from gramlake.operators import penalized
from gramlake.operators.terms import Design, num


def test_terms_shrink_to_their_targets(spark):
    rng = np.random.default_rng(15)
    x = rng.normal(size=(500, 3))
    y = x @ np.array([1.0, -2.0, 0.5]) + 3 + rng.normal(size=500)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double").cache()
    design = Design(["y"], [num("a"), num("b"), num("c")])
    fit = penalized.elastic_net(df, design, {"a": 50.0, "b": 0.0, "c": 0.3}, {"c": 0.5}, targets={"a": 2.0, "c": 1.0})
    b = dict(zip(fit.names, fit.params, strict=True))
    assert b["a"] == 2.0 and abs(fit.stats["duality_gap"]) < 1e-8
    # what is left is a fit of y - 2 a, with c pulled to 1
    m, t = np.stack([np.ones(500), x[:, 1], x[:, 2]], 1), y - 2 * x[:, 0]
    grad = m.T @ (t - m @ np.array([b["Intercept"], b["b"], b["c"]])) / 500
    np.testing.assert_allclose(grad, [0, 0, 0.15 * np.sign(b["c"] - 1) + 0.15 * (b["c"] - 1)], atol=1e-8)
    same = penalized.elastic_net(df, design, 0.1, 0.5)
    each = penalized.elastic_net(df, design, {n: 0.1 for n in "abc"}, {n: 0.5 for n in "abc"}, targets={})
    np.testing.assert_allclose(same.params, each.params, atol=1e-12)
    with pytest.raises(ValueError):
        penalized.elastic_net(df, design, 0.1, targets={"Intercept": 1.0})
