"""Joins: many tables on shared keys, interpolation at a knot table, splines."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramlake.operators import splines
from gramlake.operators.state import cut

#: Knots up to which interpolation broadcasts them; beyond it a sorted union finds the neighbours.
BROADCAST_KNOTS = 1_000_000


def merge_tables(tables: list[DataFrame], on: list[str], how: str = "outer") -> DataFrame:
    """Left-to-right joins on shared keys, which coalesce."""
    return functools.reduce(lambda a, b: a.join(b, on, how), tables)


def _clean(knots: DataFrame, x: str, y: str) -> DataFrame:
    return knots.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null").groupBy("x").agg(F.min("y").alias("y"))


def _knots(knots: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Clean knots in order, if they are few."""
    if knots.count() > BROADCAST_KNOTS:
        return None
    table = knots.toPandas().sort_values("x")  # bounded
    return table["x"].to_numpy(float), table["y"].to_numpy(float)


def interpolate(df: DataFrame, value: str, knots: DataFrame, x: str, y: str, kind: str = "linear", name: str = "y") -> DataFrame:
    """Adds ``name``: the knot table at each row's ``value``: previous, next, nearest or linear.

    Outside the knots: null, but for previous after the last and next before the first knot. Knots of a
    checked size are broadcast (no shuffle of rows); larger tables meet the rows by ranges, where each row takes the
    last knot seen upwards and downwards, plus one carried knot for each range.
    """
    clean = cut(_clean(knots, x, y))  # read several times
    small = _knots(clean)
    if small is not None:
        kx, ky = small

        @F.pandas_udf("double")
        def at(v: pd.Series) -> pd.Series:
            v = v.to_numpy(float)
            out = np.full(len(v), np.nan)
            if not len(kx):
                return pd.Series(out)
            i = np.searchsorted(kx, v, side="right") - 1
            j = np.searchsorted(kx, v, side="left")
            left, right, ok = np.clip(i, 0, len(kx) - 1), np.clip(j, 0, len(kx) - 1), ~np.isnan(v)
            has_left, has_right = ok & (i >= 0), ok & (j < len(kx))
            if kind == "previous":
                out[has_left] = ky[left[has_left]]
            elif kind == "next":
                out[has_right] = ky[right[has_right]]
            else:
                both = has_left & has_right
                a, b = left[both], right[both]
                if kind == "nearest":
                    out[both] = np.where(v[both] - kx[a] <= kx[b] - v[both], ky[a], ky[b])
                else:
                    gap = np.where(kx[b] > kx[a], kx[b] - kx[a], 1.0)
                    out[both] = ky[a] + (ky[b] - ky[a]) * (v[both] - kx[a]) / gap
            return pd.Series(out).where(~np.isnan(out), None)

        return df.withColumn(name, at(F.col(value).cast("double")))
    return _large(df, value, clean, "x", "y", kind, name)


def _large(df: DataFrame, value: str, knots: DataFrame, x: str, y: str, kind: str, name: str) -> DataFrame:
    """As-of by buckets of quantiles: rows and knots of a bucket meet by key, with the knots just outside it. Two sorts of a bucket, in time of its rows."""
    shares = [i / 1024 for i in range(1, 1024)]
    cuts = np.array(sorted(set(knots.approxQuantile(x, shares, 1e-4))))  # bounded number of cuts

    @F.pandas_udf("int")
    def bucket(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, v.to_numpy(float)))

    k = knots.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x is not null").withColumn("_b", bucket("_x"))
    ends = k.groupBy("_b").agg(F.max(F.struct("_x", "_y")).alias("l"), F.min(F.struct("_x", "_y")).alias("f")).orderBy("_b").collect()
    carried, last = [], None
    for r in ends:
        if last is not None:
            carried += [(b, last["l"]["_x"], last["l"]["_y"]) for b in range(last["_b"] + 1, r["_b"] + 1)]
            carried += [(b, r["f"]["_x"], r["f"]["_y"]) for b in range(last["_b"], r["_b"])]
        last = r
    if last is not None:
        carried += [(b, last["l"]["_x"], last["l"]["_y"]) for b in range(last["_b"] + 1, len(cuts) + 1)]
        carried += [(b, ends[0]["f"]["_x"], ends[0]["f"]["_y"]) for b in range(ends[0]["_b"])]
    near = k.select("_b", "_x", "_y").union(df.sparkSession.createDataFrame(carried, "_b int, _x double, _y double"))
    row = F.struct(*[F.col(c) for c in df.columns])
    known = F.col(value).cast("double").isNotNull() & ~F.isnan(F.col(value).cast("double"))
    rows = df.where(known).select(row.alias("_row"), F.col(value).cast("double").alias("_at")).withColumn("_b", bucket("_at"))
    rows = rows.select("_b", "_at", F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_r"), "_row")
    both = rows.unionByName(near.select("_b", F.col("_x").alias("_at"), "_y", F.lit(0).alias("_r")), allowMissingColumns=True)
    knot = F.when(F.col("_r") == 0, F.struct(F.col("_at").alias("x"), F.col("_y").alias("y")))
    # the last knot on the way up and on the way down; a frame that begins at the row would be gone through anew for each row
    so_far = lambda *order: F.last(knot, True).over(Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_p", so_far("_at", "_r")).withColumn("_n", so_far(F.desc("_at"), "_r")).where("_r = 1")
    p, n, v = F.col("_p"), F.col("_n"), F.col("_at")
    linear = F.when(p["x"] == n["x"], p["y"]).otherwise(p["y"] + (n["y"] - p["y"]) * (v - p["x"]) / (n["x"] - p["x"]))
    out = {"previous": p["y"], "next": n["y"], "nearest": F.when(p.isNotNull() & n.isNotNull(), F.when(v - p["x"] <= n["x"] - v, p["y"]).otherwise(n["y"])), "linear": linear}[kind]
    found = found.select(*[F.col("_row")[c].alias(c) for c in df.columns], out.alias(name))
    return found.union(df.where(~F.coalesce(known, F.lit(False))).withColumn(name, F.lit(None).cast("double")))


def _tridiagonal(low: np.ndarray, diagonal: np.ndarray, high: np.ndarray, r: np.ndarray) -> np.ndarray:
    """One sweep down and one up, in time and memory of the number of knots."""
    low, diagonal, high, r = (v.tolist() for v in (low, diagonal, high, r))
    for i in range(1, len(r)):
        f = low[i] / diagonal[i - 1]
        diagonal[i] -= f * high[i - 1]
        r[i] -= f * r[i - 1]
    r[-1] /= diagonal[-1]
    for i in range(len(r) - 2, -1, -1):
        r[i] = (r[i] - high[i] * r[i + 1]) / diagonal[i]
    return np.array(r)


def spline_coefficients(kx: np.ndarray, ky: np.ndarray, bc: str = "not-a-knot") -> np.ndarray:
    """Cubic spline pieces: rows (a, b, c, d) of a + b u + c u2 + d u3 with u = x - knot. Natural, clamped or not-a-knot ends."""
    n, h, d = len(kx), np.diff(kx), np.diff(ky) / np.diff(kx)
    if n == 2:
        return np.array([[ky[0], d[0], 0.0, 0.0]])
    if n == 3 and bc == "not-a-knot":
        c = (d[1] - d[0]) / (h[0] + h[1])
        b0 = d[0] - c * h[0]
        return np.array([[ky[0], b0, c, 0.0], [ky[1], b0 + 2 * c * h[0], c, 0.0]])
    # one equation a knot: low * c before + diagonal * c + high * c after = r; end conditions are put into their neighbours
    low, diagonal, high = np.zeros(n), np.ones(n), np.zeros(n)
    r = np.zeros(n)
    low[1:-1], diagonal[1:-1], high[1:-1], r[1:-1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:], 3 * np.diff(d)
    if bc == "clamped":
        diagonal[0], high[0], r[0] = 2 * h[0], h[0], 3 * d[0]
        diagonal[-1], low[-1], r[-1] = 2 * h[-1], h[-1], -3 * d[-1]
    elif bc != "natural":  # c0 = ((h0 + h1) c1 - h0 c2) / h1, and the same from the other end
        diagonal[1], high[1], low[1] = diagonal[1] + h[0] * (h[0] + h[1]) / h[1], h[1] - h[0] ** 2 / h[1], 0.0
        diagonal[-2], low[-2], high[-2] = diagonal[-2] + h[-1] * (h[-1] + h[-2]) / h[-2], h[-2] - h[-1] ** 2 / h[-2], 0.0
    c = _tridiagonal(low, diagonal, high, r)
    if bc not in ("natural", "clamped"):
        c[0] = ((h[0] + h[1]) * c[1] - h[0] * c[2]) / h[1]
        c[-1] = ((h[-1] + h[-2]) * c[-2] - h[-1] * c[-3]) / h[-2]
    return np.stack([ky[:-1], d - h * (2 * c[:-1] + c[1:]) / 3, c[:-1], np.diff(c) / (3 * h)], 1)


def spline_eval(df: DataFrame, value: str, knots: DataFrame, x: str, y: str, bc: str = "not-a-knot", derivative: int = 0, name: str = "y", kind: str = "cubic") -> DataFrame:
    """Adds the spline through a knot table, or a derivative of it (1 to 3). Outside the knots the end pieces go on.

    ``kind`` is linear, quadratic (a parabola around each inner knot, meeting midway between knots with equal slopes) or cubic.
    Pieces of up to BROADCAST_KNOTS knots are broadcast; those of more are made and met in blocks (``splines``).
    """
    clean = cut(_clean(knots, x, y))  # read several times
    small = _knots(clean)
    if small is None:
        return splines.evaluate(df, value, splines.pieces(clean, kind, bc), derivative, name)
    kx, ky = small
    if len(kx) < 2:
        raise ValueError("a spline needs two knots at least")
    if kind == "cubic":
        p = spline_coefficients(kx, ky, bc)
        starts = at = kx[: len(p)]
    else:
        table = splines.pieces_of(kx, ky, kind, bc)
        starts, at, p = table[:, 0], table[:, 1], table[:, 2:]

    @F.pandas_udf("double")
    def of(v: pd.Series) -> pd.Series:
        v = v.to_numpy(float)
        i = np.clip(np.searchsorted(starts, v, side="right") - 1, 0, len(p) - 1)
        u = v - at[i]
        a, b, c, d = p[i].T
        return pd.Series([a + u * (b + u * (c + u * d)), b + u * (2 * c + 3 * u * d), 2 * c + 6 * u * d, 6 * d + 0 * u][derivative])

    return df.withColumn(name, of(F.col(value).cast("double")))
