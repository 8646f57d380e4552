"""Kernel densities and local smoothers over grids: rows are binned or summed per grid point, the rest is grid-sized."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.operators.aggregates import quantiles
from gramlake.operators.rows import sum_rows
from gramlake.operators.terms import finite

#: Constants of the normal-reference bandwidth, support in bandwidths, by kernel.
REFERENCE = {"gaussian": 1.05922384, "epanechnikov": 2.34491436, "uniform": 1.84310992, "triangular": 2.57603039, "biweight": 2.77793668, "triweight": 3.15448080, "cosine": 2.40970953, "tricube": 2.76434501}


def _kernel(kind: str, u: np.ndarray) -> np.ndarray:
    a = np.abs(u)
    if kind == "gaussian":
        return np.exp(-0.5 * u * u) / math.sqrt(2 * math.pi)
    shapes = {"epanechnikov": 0.75 * (1 - u * u), "uniform": np.full_like(u, 0.5), "triangular": 1 - a, "biweight": 15 / 16 * (1 - u * u) ** 2, "triweight": 35 / 32 * (1 - u * u) ** 3, "cosine": math.pi / 4 * np.cos(math.pi / 2 * u), "tricube": 70 / 81 * (1 - a**3) ** 3}
    return np.where(a <= 1, shapes[kind], 0.0)


def bandwidth(df: DataFrame, x: str, kind: str = "gaussian", rule: str = "normal_reference") -> float:
    """c * min(sd, IQR / 1.34) * n^(-1/5): c is 1.059 (scott), 0.9 (silverman) or the kernel's reference constant."""
    return bandwidths(df, x, kind, rule).first().h


def bandwidths(df: DataFrame, x: str, kind: str = "gaussian", rule: str = "normal_reference", by: list[str] = (), weight: str | None = None) -> DataFrame:
    """by, h, lo, hi: every group's bandwidth and range; n is (sum w)^2 / sum w^2 with weights. Quartiles by counting passes, for all groups at once."""
    v, w = F.col(x).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(finite(v) & finite(w) & (w > 0))
    c = {"scott": 1.059, "silverman": 0.9}.get(rule, REFERENCE[kind])
    spread = F.when(F.col("q")[1] > F.col("q")[0], F.least("_sd", (F.col("q")[1] - F.col("q")[0]) / 1.34)).otherwise(F.col("_sd"))
    moments = rows.groupBy(*by).agg(F.stddev_samp(v).alias("_sd"), (F.pow(F.sum(w), 2) / F.sum(w * w)).alias("_n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    both = _met(moments, quantiles(rows, v, [0.25, 0.75], by).drop("n"), list(by))
    return both.select(*by, (c * spread * F.pow("_n", F.lit(-0.2))).alias("h"), "lo", "hi")


def _met(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Rows next to their group's columns; null is a group too."""
    other = groups.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], *[c for c in groups.columns if c not in by])
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & rows[c].eqNullSafe(other[f"_b{i}"])
    return rows.join(other, on).drop(*[f"_b{i}" for i in range(len(by))])


def kde(df: DataFrame, x: str, kind: str = "gaussian", bw: float | str = "normal_reference", gridsize: int = 1024, cut: float = 4.0, adjust: float = 1.0, by: list[str] = (), weight: str | None = None, clip: tuple[float, float] = (-math.inf, math.inf)) -> DataFrame:
    """by, x, density on gridsize bin midpoints over [min - cut h, max + cut h], normalised to integrate to 1.

    Every group has its own bandwidth and grid. Rows are counted (or weighed) into their group's bins once, an aggregate that sends a group's bins
    and no rows; a group's convolution works on its bins alone. ``clip`` leaves out values outside it and cuts grids
    to it. Groups without a spread (one value) have no density and aren't there.
    """
    by = list(by)
    v, w = F.col(x).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(finite(v) & finite(w) & (w > 0) & v.between(*map(float, clip)))
    groups = bandwidths(rows, x, kind, bw if isinstance(bw, str) else "normal_reference", by, weight)
    h = F.lit(float(bw)) if not isinstance(bw, str) else F.col("h")
    groups = groups.withColumn("h", h * adjust).where("h > 0")
    groups = groups.withColumn("lo", F.greatest(F.col("lo") - cut * F.col("h"), F.lit(float(clip[0])))).withColumn("width", (F.least(F.col("hi") + cut * F.col("h"), F.lit(float(clip[1]))) - F.col("lo")) / gridsize)
    own = rows.select(*by, v.alias("_v"), w.alias("_w"))
    placed = _met(own, groups.select(*by, "h", "lo", "width"), by).withColumn("bin", F.least(F.greatest(F.floor((F.col("_v") - F.col("lo")) / F.col("width")), F.lit(0)), F.lit(gridsize - 1)).cast("int"))
    bins = placed.groupBy(*by, "h", "lo", "width", "bin").agg(F.sum("_w").alias("c"))
    vectors = bins.groupBy(*by, "h", "lo", "width").agg(F.collect_list(F.struct("bin", "c")).alias("l"))  # gridsize entries a group
    vectors = vectors.select(*by, "h", "lo", "width", F.transform("l", lambda e: e["bin"].cast("double")).alias("i"), F.transform("l", lambda e: e["c"]).alias("c"))
    size = 1 << (3 * gridsize - 2).bit_length()

    @F.pandas_udf("array<double>")
    def smooth(h, width, i, c):
        import pandas as pd

        out = []
        for one, step, at, count in zip(h, width, i, c, strict=True):
            a = np.zeros(gridsize)
            a[np.asarray(at, int)] = count
            weights = _kernel(kind, np.arange(-gridsize + 1, gridsize) * step / one) / one
            d = np.maximum(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(weights, size), size)[gridsize - 1 : 2 * gridsize - 1], 0)
            out.append((d / (d.sum() * step)).tolist())
        return pd.Series(out)

    points = vectors.select(*by, "lo", "width", F.posexplode(smooth("h", "width", "i", "c")).alias("_i", "density"))
    return points.select(*by, (F.col("lo") + (F.col("_i") + 0.5) * F.col("width")).alias("x"), "density")


def kernel_smooth_direct(df: DataFrame, x: str, y: str, grid: list[float], h: float | None = None, weight: str | None = None) -> DataFrame:
    """x, y: the Gaussian-weighted mean at each grid point, exactly. One pass; a task adds two numbers a point."""
    v = F.col(x).cast("double")
    rows = df.where(finite(v) & finite(F.col(y).cast("double"))).select(v.alias("x"), F.col(y).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    if h is None:
        n, sd = rows.agg(F.count("*"), F.stddev_pop("x")).first()
        h = 1.069 * sd * n ** (-1 / 5)
    g = np.asarray(grid, float)

    def kernel(c):
        k = np.exp(-0.5 * ((c["x"][:, None] - g) / h) ** 2) * c["w"][:, None]
        return np.concatenate([k.sum(0), (k * c["y"][:, None]).sum(0)])

    s = sum_rows(rows, kernel)
    out = [(float(a), float(q / p) if p > 0 else None) for a, p, q in zip(g, s[: len(g)], s[len(g) :], strict=True)] if len(s) else []
    return df.sparkSession.createDataFrame(out, "x double, y double")


def kernel_smooth(df: DataFrame, x: str, y: str, bins: int = 1024, h: float | None = None) -> DataFrame:
    """x, y: the same on bin midpoints of a power-of-two grid, from binned sums and one transform."""
    v, u = F.col(x).cast("double"), F.col(y).cast("double")
    ok = df.where(finite(v) & finite(u))
    n, sd, lo, hi = ok.agg(F.count("*"), F.stddev_pop(v), F.min(v), F.max(v)).first()
    h = h or 1.069 * sd * n ** (-1 / 5)
    width = (hi - lo) / bins or 1.0
    sums = ok.groupBy(F.least(F.floor((v - lo) / width), F.lit(bins - 1)).cast("int").alias("b")).agg(F.count("*").alias("n"), F.sum(u).alias("s")).collect()  # one row a bin
    a, b = np.zeros(bins), np.zeros(bins)
    for r in sums:
        a[r.b], b[r.b] = r.n, r.s
    k = np.exp(-0.5 * (np.arange(-bins + 1, bins) * width / h) ** 2)
    size = 1 << (3 * bins).bit_length()
    f = np.fft.rfft(k, size)
    p, q = (np.fft.irfft(np.fft.rfft(z, size) * f, size)[bins - 1 : 2 * bins - 1] for z in (a, b))
    return df.sparkSession.createDataFrame([(lo + (i + 0.5) * width, float(q[i] / p[i]) if p[i] > 1e-9 else None) for i in range(bins)], "x double, y double")


def lowess(df: DataFrame, x: str, y: str, grid: list[float], frac: float = 2 / 3, degree: int = 1, robust: int = 0) -> DataFrame:
    """x, y: local polynomials at grid points with tricube weights on the nearest frac * n rows.

    Each point's bandwidth is the distance of its k-th nearest row, found for all points at once by
    counting passes over a shrinking bracket; then one pass of local moment sums. ``robust`` rounds
    reweigh rows by bisquare residuals from the line between grid fits.
    """
    v, u = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(finite(v) & finite(u)).select(v.alias("x"), u.alias("y")).persist()
    g = np.asarray(grid, float)
    m = len(g)
    try:
        n, lo, hi = rows.agg(F.count("*"), F.min("x"), F.max("x")).first()
        if not n:
            return df.sparkSession.createDataFrame([], "x double, y double")
        k = int(frac) if frac > 1 else max(int(frac * n), 2)
        low, high, below = np.zeros(m), np.full(m, (hi - lo) + np.abs(g - np.clip(g, lo, hi)).max() + 1e-12), np.zeros(m)
        bins = 64
        for _ in range(5):
            width = (high - low) / bins

            def count(c, low=low, width=width):
                d = np.abs(c["x"][:, None] - g)
                b = np.clip(np.ceil((d - low) / width), 0, bins + 1).astype(int)
                return np.stack([np.bincount(b[:, i], minlength=bins + 2) for i in range(m)]).ravel()

            cum = np.cumsum(sum_rows(rows, count).reshape(m, bins + 2), axis=1)
            b = np.minimum((cum < k).sum(axis=1), bins)
            low, high = low + np.maximum(b - 1, 0) * width, low + np.maximum(b, 1) * width
        h = high * 1.005 + 1e-12
        fit = s6 = None
        for r in range(robust + 1):

            def moments(c, fit=fit, s6=s6):
                d = c["x"][:, None] - g
                w = np.clip(1 - np.abs(d / h) ** 3, 0, None) ** 3
                if fit is not None:
                    e = c["y"] - np.interp(c["x"], g, fit)
                    w = w * (np.clip(1 - (e / s6) ** 2, 0, None) ** 2)[:, None]
                z = d / h
                return np.concatenate([(w * z**p).sum(0) for p in range(2 * degree + 1)] + [(w * z**p * c["y"][:, None]).sum(0) for p in range(degree + 1)])

            s = sum_rows(rows, moments).reshape(3 * degree + 2, m)
            fit = np.empty(m)
            for i in range(m):
                a = np.array([[s[p + q, i] for q in range(degree + 1)] for p in range(degree + 1)])
                fit[i] = np.linalg.lstsq(a, s[2 * degree + 1 :, i], rcond=None)[0][0]
            if r < robust:
                from gramlake.operators.aggregates import exact_quantile

                shared = fit

                @F.pandas_udf("double")
                def resid(xs, ys, shared=shared):
                    import pandas as pd

                    return pd.Series(np.abs(ys.to_numpy(float) - np.interp(xs.to_numpy(float), g, shared)))

                s6 = 6 * max(exact_quantile(rows.select(resid("x", "y").alias("e")), F.col("e"), 0.5), 1e-300)
    finally:
        rows.unpersist()
    return df.sparkSession.createDataFrame([(float(a), float(b)) for a, b in zip(g, fit, strict=True)], "x double, y double")
