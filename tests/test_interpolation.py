"""Interpolation at knot tables too large to broadcast."""

import math

import pytest

from gramlake.operators import joins


@pytest.mark.parametrize("kind", ["previous", "next", "nearest", "linear"])
def test_large_knot_tables(spark, monkeypatch, kind):
    knots = spark.createDataFrame([(float(i), float((i * 7919) % 101)) for i in range(0, 3000, 3)] + [(6.0, 500.0), (None, 1.0), (5.0, None)], "kx double, ky double")
    values = [0.25 * i for i in range(-40, 200)] + [2997.0, 2997.5, None, math.nan, 1500.0, 1500.0]
    frame = spark.createDataFrame(list(enumerate(values)), "id long, v double").repartition(3)
    small = {r.id: r.y for r in joins.interpolate(frame, "v", knots, "kx", "ky", kind).collect()}
    monkeypatch.setattr(joins, "BROADCAST_KNOTS", 10)
    large = joins.interpolate(frame, "v", knots, "kx", "ky", kind)
    assert large.columns == ["id", "v", "y"]
    assert {r.id: r.y for r in large.collect()} == pytest.approx(small)
    # a frame from a row to the end of its partition is gone through once for each row
    assert "unboundedfollowing" not in large._jdf.queryExecution().toString().lower()
