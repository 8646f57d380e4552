"""Scalar functions as Column expressions, and vectorized special functions where Spark has none."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gramlake.functions import special

_PI = math.pi


def logit(p: Column) -> Column:
    return F.log(p) - F.log1p(-p)


def expit(x: Column) -> Column:
    """1 / (1 + exp(-x)), from the side that doesn't overflow."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def d_expit(x: Column) -> Column:
    small = F.exp(-F.abs(x))
    return small / ((1 + small) * (1 + small))


def log_d_expit(x: Column) -> Column:
    return -F.abs(x) - 2 * F.log1p(F.exp(-F.abs(x)))


def _vectorized(f):
    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            return pd.Series(np.asarray(f(*[c.to_numpy(float) for c in columns]), float))

    return run


def special_function(name: str, *columns: Column) -> Column:
    """erf, erfc, ndtr, gamma, gammaln, beta, betaln, digamma over Arrow batches; null in, NaN out."""
    table = {"erf": special.erf, "erfc": special.erfc, "ndtr": special.ndtr, "gamma": special.gamma, "gammaln": special.gammaln, "betaln": special.betaln, "beta": lambda a, b: np.exp(special.betaln(a, b)), "digamma": special.digamma}
    return _vectorized(table[name])(*[c.cast("double") for c in columns])


def _ln_gamma(c: Column) -> Column:
    return special_function("gammaln", c)


def logpdf(kind: str, x: Column, loc: Column = None, scale: Column = None, **shape: Column) -> Column:
    """Log-density of a named distribution with location and scale; parameters may be columns. Null outside the support's closure is -inf."""
    loc = F.lit(0.0) if loc is None else loc
    scale = F.lit(1.0) if scale is None else scale
    z = (x - loc) / scale
    s = {k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in shape.items()}
    low = F.lit(-math.inf)
    ln = F.log(scale)
    if kind == "norm":
        out = -0.5 * z * z - 0.5 * math.log(2 * _PI)
    elif kind == "lognorm":
        out = F.when(z > 0, -0.5 * F.pow(F.log(z) / s["s"], 2) - F.log(z * s["s"]) - 0.5 * math.log(2 * _PI)).otherwise(low)
    elif kind == "expon":
        out = F.when(z >= 0, -z).otherwise(low)
    elif kind == "laplace":
        out = -F.abs(z) - math.log(2)
    elif kind == "cauchy":
        out = -F.log1p(z * z) - math.log(_PI)
    elif kind == "logistic":
        out = log_d_expit(z)
    elif kind == "halfnorm":
        out = F.when(z >= 0, -0.5 * z * z + 0.5 * math.log(2 / _PI)).otherwise(low)
    elif kind == "halfcauchy":
        out = F.when(z >= 0, math.log(2 / _PI) - F.log1p(z * z)).otherwise(low)
    elif kind == "pareto":
        out = F.when(z >= 1, F.log(s["b"]) - (s["b"] + 1) * F.log(z)).otherwise(low)
    elif kind == "weibull_min":
        out = F.when(z > 0, F.log(s["c"]) + (s["c"] - 1) * F.log(z) - F.pow(z, s["c"])).otherwise(low)
    elif kind == "genextreme":
        t = 1 - s["c"] * z
        out = F.when(s["c"] == 0, -z - F.exp(-z)).when(t > 0, (1 / s["c"] - 1) * F.log(t) - F.pow(t, 1 / s["c"])).otherwise(low)
    elif kind == "gamma":
        out = F.when(z > 0, (s["a"] - 1) * F.log(z) - z - _ln_gamma(s["a"])).otherwise(low)
    elif kind == "invgamma":
        out = F.when(z > 0, -(s["a"] + 1) * F.log(z) - 1 / z - _ln_gamma(s["a"])).otherwise(low)
    elif kind == "chi2":
        out = F.when(z > 0, (s["df"] / 2 - 1) * F.log(z) - z / 2 - s["df"] / 2 * math.log(2) - _ln_gamma(s["df"] / 2)).otherwise(low)
    elif kind == "beta":
        out = F.when((z > 0) & (z < 1), (s["a"] - 1) * F.log(z) + (s["b"] - 1) * F.log1p(-z) - special_function("betaln", s["a"], s["b"])).otherwise(low)
    elif kind == "t":
        out = _ln_gamma((s["df"] + 1) / 2) - _ln_gamma(s["df"] / 2) - 0.5 * F.log(s["df"] * _PI) - (s["df"] + 1) / 2 * F.log1p(z * z / s["df"])
    elif kind == "f":
        a, b = s["d1"], s["d2"]
        out = F.when(z > 0, a / 2 * F.log(a / b) + (a / 2 - 1) * F.log(z) - (a + b) / 2 * F.log1p(a * z / b) - special_function("betaln", a / 2, b / 2)).otherwise(low)
    elif kind == "truncnorm":
        inside = special_function("ndtr", s["b"]) - special_function("ndtr", s["a"])
        out = F.when((z >= s["a"]) & (z <= s["b"]), -0.5 * z * z - 0.5 * math.log(2 * _PI) - F.log(inside)).otherwise(low)
    else:
        raise ValueError(f"unknown distribution {kind}")
    return out - ln


def pdf(kind: str, x: Column, loc: Column = None, scale: Column = None, **shape: Column) -> Column:
    return F.exp(logpdf(kind, x, loc, scale, **shape))


def mvn_logpdf(x: Column, mean: np.ndarray, cov: np.ndarray, df: float | None = None) -> Column:
    """Log-density of a multivariate normal (or t with ``df``) at an array column; one Cholesky, one batch at a time."""
    chol, mean = np.linalg.cholesky(np.asarray(cov, float)), np.asarray(mean, float)
    k, logdet = len(mean), 2 * np.log(np.diag(np.linalg.cholesky(np.asarray(cov, float)))).sum()

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        z = np.linalg.solve(chol, (np.stack([np.asarray(a, float) for a in v]) - mean).T)
        q = (z * z).sum(axis=0)
        if df is None:
            return pd.Series(-0.5 * (k * math.log(2 * math.pi) + logdet + q))
        c = float(special.gammaln((df + k) / 2) - special.gammaln(df / 2)) - 0.5 * (k * math.log(df * math.pi) + logdet)
        return pd.Series(c - (df + k) / 2 * np.log1p(q / df))

    return run(x)


def kernel(kind: str, u: Column) -> Column:
    """Smoothing kernels with unit integral."""
    a = F.abs(u)
    inside = {
        "epanechnikov": 0.75 * (1 - u * u),
        "uniform": F.lit(0.5),
        "triweight": 35 / 32 * F.pow(1 - u * u, 3),
        "biweight": 15 / 16 * F.pow(1 - u * u, 2),
        "cosine": _PI / 4 * F.cos(_PI / 2 * u),
        "triangular": 1 - a,
        "tricube": 70 / 81 * F.pow(1 - F.pow(a, 3), 3),
    }
    if kind == "gaussian":
        return F.exp(-0.5 * u * u) / math.sqrt(2 * _PI)
    return F.when(a <= 1, inside[kind]).otherwise(0.0)


#: The tuning constants of the robust norms.
NORMS = {"HuberT": 1.345, "TukeyBiweight": 4.685, "TrimmedMean": 2.0, "AndrewWave": 1.339, "RamsayE": 0.3, "LeastSquares": 0.0}


def robust_weight(kind: str, z: Column) -> Column:
    """psi(z) / z of a robust norm."""
    c, a = NORMS[kind], F.abs(z)
    if kind == "HuberT":
        return F.when(a <= c, 1.0).otherwise(c / a)
    if kind == "TukeyBiweight":
        return F.when(a <= c, F.pow(1 - F.pow(z / c, 2), 2)).otherwise(0.0)
    if kind == "TrimmedMean":
        return F.when(a <= c, 1.0).otherwise(0.0)
    if kind == "AndrewWave":
        return F.when(z == 0, 1.0).when(a < c * _PI, F.sin(z / c) / (z / c)).otherwise(0.0)
    if kind == "RamsayE":
        return F.exp(-c * a)
    return F.lit(1.0)


def robust_rho(kind: str, z: Column) -> Column:
    c, a = NORMS[kind], F.abs(z)
    if kind == "HuberT":
        return F.when(a <= c, z * z / 2).otherwise(c * a - c * c / 2)
    if kind == "TukeyBiweight":
        return F.when(a <= c, c * c / 6 * (1 - F.pow(1 - F.pow(z / c, 2), 3))).otherwise(c * c / 6)
    if kind == "TrimmedMean":
        return F.when(a <= c, z * z / 2).otherwise(c * c / 2)
    if kind == "AndrewWave":
        return F.when(a < c * _PI, c * c * (1 - F.cos(z / c))).otherwise(2 * c * c)
    if kind == "RamsayE":
        return (1 - F.exp(-c * a) * (1 + c * a)) / (c * c)
    return z * z / 2
