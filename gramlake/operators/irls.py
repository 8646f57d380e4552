"""Iteratively reweighted fits: generalized linear models, robust regression, quantile regression.

Each iteration is one pass over a cached projection that returns k x k sums; nothing of row size is
collected and nothing is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.functions import special
from gramlake.operators.checkloss import band_rows, nearer, settle
from gramlake.operators.linear import Fit, centred, solve_scaled
from gramlake.operators.rows import BLOCK_ROWS, numpy_columns, sum_columns, sum_rows
from gramlake.operators.terms import Design, Plan

_EPS = 1e-10
#: Length of a step, in standard errors, below which one that is no shorter than the step before is rounding.
ROUNDING = 1e-6


class Link:
    """g, its inverse and g'(mu), in numpy, and the inverse as a Column."""

    def __init__(self, name: str, power: float = 1.0, alpha: float = 1.0):
        self.name, self.power, self.alpha = name, power, alpha

    def inverse(self, eta: np.ndarray) -> np.ndarray:
        n = self.name
        if n == "log":
            return np.exp(np.clip(eta, -700, 700))
        if n == "identity":
            return eta
        if n == "logit":
            return 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        if n == "probit":
            return special.ndtr(eta)
        if n == "cauchy":
            return 0.5 + np.arctan(eta) / math.pi
        if n == "cloglog":
            return -np.expm1(-np.exp(np.clip(eta, -700, 700)))
        if n == "sqrt":
            return eta * eta
        if n == "inverse":
            return 1 / eta
        if n == "negative_inverse":
            return -1 / eta
        if n == "inverse_squared":
            return 1 / np.sqrt(np.maximum(eta, _EPS))
        if n == "negative_two_inverse_squared":
            return 1 / np.sqrt(np.maximum(-2 * eta, _EPS))
        if n == "power":
            return np.maximum(eta, _EPS) ** (1 / self.power)
        if n == "nb":
            e = np.exp(np.minimum(eta, -1e-12))
            return e / (self.alpha * (1 - e))
        if n == "ztp":  # log of the untruncated rate; the mean of the truncated count
            lam = np.exp(np.clip(eta, -30, 30))
            return lam / -np.expm1(-lam)
        raise ValueError(f"unknown link {n}")

    def derivative(self, eta: np.ndarray, mu: np.ndarray) -> np.ndarray:
        """d eta / d mu."""
        n = self.name
        if n == "log":
            return 1 / np.maximum(mu, _EPS)
        if n == "identity":
            return np.ones_like(mu)
        if n == "logit":
            return 1 / np.maximum(mu * (1 - mu), _EPS)
        if n == "probit":
            return math.sqrt(2 * math.pi) * np.exp(0.5 * np.minimum(eta * eta, 500))
        if n == "cauchy":
            return math.pi * (1 + eta * eta)
        if n == "cloglog":
            return 1 / np.maximum((1 - mu) * np.exp(np.clip(eta, -700, 700)), _EPS)
        if n == "sqrt":
            return 0.5 / np.sqrt(np.maximum(mu, _EPS))
        if n == "inverse":
            return -1 / (mu * mu)
        if n == "negative_inverse":
            return 1 / (mu * mu)
        if n == "inverse_squared":
            return -2 / mu**3
        if n == "negative_two_inverse_squared":
            return 1 / mu**3
        if n == "power":
            return self.power * np.maximum(mu, _EPS) ** (self.power - 1)
        if n == "nb":
            return 1 / (mu + self.alpha * mu * mu)
        if n == "ztp":
            lam = np.exp(np.clip(eta, -30, 30))
            p = -np.expm1(-lam)
            return 1 / (lam * (p - lam * np.exp(-lam)) / (p * p))
        raise ValueError(f"unknown link {n}")

    def column(self, eta: Column) -> Column:
        from gramlake.functions.columns import expit, special_function

        table = {"log": F.exp, "identity": lambda x: x, "logit": expit, "probit": lambda x: special_function("ndtr", x), "cauchy": lambda x: F.lit(0.5) + F.atan(x) / math.pi, "cloglog": lambda x: -F.expm1(-F.exp(x)), "sqrt": lambda x: x * x, "inverse": lambda x: 1 / x, "negative_inverse": lambda x: -1 / x, "inverse_squared": lambda x: 1 / F.sqrt(x), "negative_two_inverse_squared": lambda x: 1 / F.sqrt(-2 * x), "power": lambda x: F.pow(x, 1 / self.power)}
        return table[self.name](eta)


#: Family: variance function, unit deviance, canonical link, support check and whether the scale is 1.
FAMILIES = {
    "binomial": ("logit", lambda y: (y >= 0) & (y <= 1), True),
    "poisson": ("log", lambda y: y >= 0, True),
    "zero_truncated_poisson": ("ztp", lambda y: y >= 1, True),
    "gaussian": ("identity", lambda y: F.lit(True), False),
    "gamma": ("negative_inverse", lambda y: y > 0, False),
    "inverse_gaussian": ("negative_two_inverse_squared", lambda y: y > 0, False),
    "negative_binomial": ("log", lambda y: y >= 0, True),
}


def variance(family: str, mu: np.ndarray, alpha: float, eta: np.ndarray) -> np.ndarray:
    if family == "binomial":
        return np.maximum(mu * (1 - mu), _EPS)
    if family == "poisson":
        return np.maximum(mu, _EPS)
    if family == "zero_truncated_poisson":
        lam = np.exp(np.clip(eta, -30, 30))
        return np.maximum(mu * (1 + lam - mu), _EPS)
    if family == "gaussian":
        return np.ones_like(mu)
    if family == "gamma":
        return np.maximum(mu * mu, _EPS)
    if family == "inverse_gaussian":
        return np.maximum(mu**3, _EPS)
    return np.maximum(mu + alpha * mu * mu, _EPS)


def deviance(family: str, y: np.ndarray, mu: np.ndarray, alpha: float, eta: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        log_ratio = np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / np.maximum(mu, 1e-300)), 0.0)
        if family == "binomial":
            return 2 * (log_ratio + np.where(y < 1, (1 - y) * np.log(np.where(y < 1, 1 - y, 1) / np.maximum(1 - mu, 1e-300)), 0.0))
        if family == "poisson":
            return 2 * (log_ratio - (y - mu))
        if family == "gaussian":
            return (y - mu) ** 2
        if family == "gamma":
            return 2 * ((y - mu) / mu - np.log(y / mu))
        if family == "inverse_gaussian":
            return (y - mu) ** 2 / (mu * mu * y)
        if family == "zero_truncated_poisson":
            return -2 * llf(family, y, mu, alpha, eta, 1.0)
        return 2 * (log_ratio - (y + 1 / alpha) * np.log((1 + alpha * y) / (1 + alpha * mu)))


def llf(family: str, y: np.ndarray, mu: np.ndarray, alpha: float, eta: np.ndarray, scale: float) -> np.ndarray:
    """Log-likelihood of each row."""
    g = special.gammaln
    if family == "binomial":
        return np.where(y > 0, y * np.log(np.maximum(mu, 1e-300)), 0) + np.where(y < 1, (1 - y) * np.log(np.maximum(1 - mu, 1e-300)), 0)
    if family == "poisson":
        return y * np.log(np.maximum(mu, 1e-300)) - mu - g(y + 1)
    if family == "zero_truncated_poisson":
        lam = np.exp(np.clip(eta, -30, 30))
        return y * np.log(lam) - lam - g(y + 1) - np.log(-np.expm1(-lam))
    if family == "gaussian":
        return -0.5 * (np.log(2 * math.pi * scale) + (y - mu) ** 2 / scale)
    if family == "gamma":
        k = 1 / scale
        return k * np.log(k * y / mu) - k * y / mu - np.log(y) - g(k)
    if family == "inverse_gaussian":
        return -0.5 * (np.log(2 * math.pi * scale * y**3) + (y - mu) ** 2 / (scale * mu * mu * y))
    s = 1 / alpha
    return g(y + s) - g(s) - g(y + 1) + y * np.log(np.maximum(alpha * mu, 1e-300)) - (y + s) * np.log1p(alpha * mu)


def _start(family: str, y: np.ndarray) -> np.ndarray:
    return (y + 0.5) / 2 if family == "binomial" else y + 1.2 if family == "zero_truncated_poisson" else np.maximum(y, 0) + 0.1 if family in ("poisson", "negative_binomial") else y


def _g(link: Link, mu: np.ndarray) -> np.ndarray:
    n = link.name
    if n == "ztp":
        return np.log(np.maximum(mu - 1, 0.1))
    table = {"log": np.log, "identity": lambda m: m, "logit": lambda m: np.log(m / (1 - m)), "probit": lambda m: 4.91 * (m**0.14 - (1 - m) ** 0.14), "cauchy": lambda m: np.tan(math.pi * (m - 0.5)), "cloglog": lambda m: np.log(-np.log1p(-m)), "sqrt": np.sqrt, "inverse": lambda m: 1 / m, "negative_inverse": lambda m: -1 / m, "inverse_squared": lambda m: 1 / m**2, "negative_two_inverse_squared": lambda m: -0.5 / m**2, "power": lambda m: m**link.power, "nb": lambda m: np.log(link.alpha * m / (1 + link.alpha * m))}
    return table[n](mu)


def glm(df: DataFrame, design: Design, family: str, link: str | None = None, cov_type: str = "NONROBUST", alpha: float = 1.0, penalty: tuple[float, float] | None = None, penalty_matrix: np.ndarray | None = None, power: float = 1.0, max_iter: int = 100, tol: float = 1e-8) -> Fit:
    """Generalized linear model by IRLS; one pass an iteration over a cached projection, no shuffle.

    ``penalty`` is (alpha, l1_ratio) on columns scaled by their deviation, intercept free; ``penalty_matrix``
    is added to X'WX. Outcomes outside the family's support are refused. HC1 uses the observed scores.
    Iterations end at ``tol``, or where steps far below the errors no longer shrink: rounding, which near collinear columns magnify, is all that is left of them.
    """
    canonical, support, fixed = FAMILIES[family]
    g = Link(link or canonical, power, alpha)
    plan = whole = design.fit(df)
    rows = plan.rows(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        moved = centred(rows, plan)
        plan = moved.plan
        bad = rows.where(~support(F.col("y0"))).limit(1).count()
        if bad:
            raise ValueError(f"outcomes outside the support of {family}")
        k = len(plan.names)
        beta, n, dev, change = None, 0.0, math.inf, math.inf
        ridge = np.zeros((k, k)) if penalty_matrix is None else np.asarray(penalty_matrix, float)
        for iteration in range(max_iter):

            def step(c, beta=beta):
                x, y, w = plan.matrix(c), plan.outcomes(c)[:, 0], c["w"]
                if beta is None:
                    mu = _start(family, y)
                    eta = _g(g, mu)
                else:
                    eta = x @ beta
                    mu = g.inverse(eta)
                d = g.derivative(eta, mu)
                wt = w / (d * d * variance(family, mu, alpha, eta))
                z = eta + (y - mu) * d
                xw = x * wt[:, None]
                return np.concatenate([[len(x), w.sum(), (w * deviance(family, y, mu, alpha, eta)).sum()], (x.T @ xw).ravel(), xw.T @ z, (x * w[:, None]).sum(0), (x * x * w[:, None]).sum(0)])

            s = sum_rows(rows, step)
            if not len(s):
                raise ValueError("no valid rows")
            n, sw, new_dev = s[:3]
            xx, xz = s[3 : 3 + k * k].reshape(k, k), s[3 + k * k : 3 + k * k + k]
            if penalty:
                from gramlake.operators.penalized import coordinate_descent

                mean = s[3 + k * k + k : 3 + k * k + 2 * k] / sw
                sd = np.sqrt(np.maximum(s[3 + k * k + 2 * k :] / sw - mean * mean, 0))
                free = np.array([nm == "Intercept" for nm in plan.names])
                l1 = np.where(free, 0, penalty[0] * penalty[1] * sd)
                l2 = np.where(free, 0, penalty[0] * (1 - penalty[1]) * sd * sd)
                new = coordinate_descent(xx / n, xz / n, l1, l2, start=beta)
                bread = solve_scaled(xx + n * np.diag(l2), xz)[1]
            else:
                new, bread = solve_scaled(xx + ridge, xz)
            before, change = change, np.max(np.abs(new - beta)) if beta is not None else math.inf
            errors = math.inf if beta is None else math.sqrt(max((new - beta) @ xx @ (new - beta), 0.0) / (1.0 if fixed else max(new_dev / n, 1e-300)))
            beta, dev = new, new_dev
            if change < tol * max(1.0, np.max(np.abs(beta))) or change >= before and errors < ROUNDING:
                break

        def last(c, scale=1.0):
            x, y, w = plan.matrix(c), plan.outcomes(c)[:, 0], c["w"]
            eta = x @ beta
            mu = g.inverse(eta)
            v, d = variance(family, mu, alpha, eta), g.derivative(eta, mu)
            score = x * (w * (y - mu) / (d * v))[:, None]
            return np.concatenate([[(w * deviance(family, y, mu, alpha, eta)).sum(), (w * (y - mu) ** 2 / v).sum(), (w * y).sum(), w.sum()], (x.T @ (x * (w / (d * d * v))[:, None])).ravel(), (score.T @ score).ravel()])

        s = sum_rows(rows, last)
        xx, meat = s[4 : 4 + k * k].reshape(k, k), s[4 + k * k :].reshape(k, k)
        bread = solve_scaled(xx + ridge, np.zeros(k))[1] if not penalty else bread
        df_resid = n - k
        scale = 1.0 if fixed else s[1] / df_resid
        ybar = s[2] / s[3]

        def likelihoods(c):
            y, w = plan.outcomes(c)[:, 0], c["w"]
            eta = plan.matrix(c) @ beta
            mu = g.inverse(eta)
            null_eta = np.full(len(y), _g(g, np.array([ybar]))[0])
            null_mu = np.full(len(y), ybar)
            return np.array([(w * llf(family, y, mu, alpha, eta, scale)).sum(), (w * llf(family, y, null_mu, alpha, null_eta, scale)).sum(), (w * deviance(family, y, null_mu, alpha, null_eta)).sum()])

        t = sum_rows(rows, likelihoods)
    finally:
        rows.unpersist()
    cov = bread @ meat @ bread * (n / (n - k)) if cov_type == "HC1" else bread @ xx @ bread * scale if penalty_matrix is not None else bread * scale
    stats = {"n": n, "iterations": iteration + 1, "converged": iteration + 1 < max_iter, "deviance": s[0], "pearson_chi2": s[1], "scale": scale, "llf": t[0], "llf_null": t[1], "null_deviance": t[2], "pseudo_r2": 1 - t[0] / t[1] if t[1] else math.nan, "df_resid": df_resid, "effective_df": float(np.trace(bread @ xx))}
    fit = moved.fit(Fit(plan.names, beta, cov, df_resid, stats, bread, plan, use_t=not fixed), whole)
    fit.link = g
    fit.family = family
    return fit


def predict(fit: Fit, df: DataFrame, name: str = "mu") -> DataFrame:
    """The mean as a Column: linear predictor, then the inverse link."""
    return fit.plan.predictions(df, fit.params, name, fit.link.column)


def marginal_effects(fit: Fit, df: DataFrame, columns: list[str], kind: str = "dydx", at: str = "all") -> dict[str, tuple[float, float]]:
    """Effects of numeric terms that enter linearly, with delta-method errors: dydx, eydx, dyex or eyex.

    ``at``: averaged over all rows (one pass), or at the mean or the median of every design column.
    """
    inner = getattr(fit, "inner", fit)  # about the columns' means, where the delta method's sums don't cancel
    plan, beta, g = inner.plan, inner.params, fit.link
    moved = plan.shift.get("x", np.zeros(len(beta)))
    k, where = len(beta), [plan.names.index(c) for c in columns]
    rows = plan.rows(df)

    def slope(eta):
        mu = g.inverse(eta)
        d = 1 / g.derivative(eta, mu)
        return d / mu if kind.startswith("ey") else d

    def effects(x, w):
        eta = x @ beta
        f, h = slope(eta), 1e-5
        fp = (slope(eta + h) - slope(eta - h)) / (2 * h)
        out = [[w.sum()]]
        for j in where:
            scale = x[:, j] + moved[j] if kind.endswith("ex") else 1.0
            out.append([(w * f * scale * beta[j]).sum()])
            jac = (x * (w * fp * scale * beta[j])[:, None]).sum(0)
            jac[j] += (w * f * scale).sum()
            out.append(jac)
        return np.concatenate(out)

    if at == "all":
        s = sum_rows(rows, lambda c: effects(plan.matrix(c), c["w"]))
    elif at == "mean":
        s = sum_rows(rows, lambda c: np.concatenate([[c["w"].sum()], c["w"] @ plan.matrix(c)]))
        s = effects((s[1:] / s[0])[None, :], np.ones(1))
    elif at == "median":
        from gramlake.operators.aggregates import exact_quantile

        plain = plan.plain()
        if plain is None:
            raise ValueError("dummies have no median")
        s = effects(np.array([[1.0 if i == 0 and plan.design.intercept else exact_quantile(rows, c, 0.5) for i, c in enumerate(plain)]]), np.ones(1))
    else:
        raise ValueError("at is all, mean or median")
    result = {}
    for i, c in enumerate(columns):
        a = 1 + i * (k + 1)
        jac = s[a + 1 : a + 1 + k] / s[0]
        result[c] = (float(s[a] / s[0]), float(math.sqrt(jac @ inner.cov @ jac)))
    return result


def glm_bootstrap(fit: Fit, df: DataFrame, key: list[str] | str, replicates: int, kind: str = "bayesian", seed: int = 0) -> tuple[Fit, np.ndarray]:
    """Draws of a generalized linear model's coefficients, and the fit with their covariance: all replicates in one pass.

    Each replicate is one Newton step from the fit under that replicate's row weights, which come from hashes of ``key``.
    """
    from gramlake.operators.resample import hashed, replicate_sums

    inner = getattr(fit, "inner", fit)
    plan, beta, g, k = inner.plan, inner.params, fit.link, len(fit.params)
    back = np.eye(k)
    back[0, 1:] = -plan.shift["x"][1:] if "x" in plan.shift else 0.0

    def kernel(c):
        x, y = plan.matrix(c), plan.outcomes(c)[:, 0]
        eta = x @ beta
        mu = g.inverse(eta)
        v, d = variance(fit.family, mu, 1.0, eta), g.derivative(eta, mu)
        score = x * (c["w"] * (y - mu) / (d * v))[:, None]
        return np.concatenate([score, (x[:, :, None] * (x * (c["w"] / (d * d * v))[:, None])[:, None, :]).reshape(len(x), -1)], 1)

    _, s = replicate_sums(plan.rows(df, keep=[hashed(key).alias("_h")]), [], kernel, replicates, kind, seed)
    draws = np.stack([back @ (beta + solve_scaled(r[k:].reshape(k, k), r[:k])[0]) for r in s])
    out = Fit(fit.names, fit.params, np.atleast_2d(np.cov(draws.T)), fit.df_resid, fit.stats, fit.bread, fit.plan, use_t=fit.use_t)
    out.link, out.family = g, fit.family
    return out, draws


def residual_inclusion(df: DataFrame, design: Design, endogenous: str, family: str, order: int = 1, **more) -> Fit:
    """IV for a nonlinear model: first-stage residuals of ``endogenous`` on the instruments enter with powers 1..order."""
    from gramlake.operators.linear import ols
    from gramlake.operators.terms import num, poly

    first = ols(df, Design([endogenous], design.instruments, weights=design.weights))
    with_fit = first.plan.predictions(df, first.params, "_hat")
    df = with_fit.withColumn("_resid", F.col(endogenous) - F.col("_hat"))
    terms = [*design.x, poly("_resid", order) if order > 1 else num("_resid")]
    return glm(df, Design(design.y, terms, weights=design.weights, intercept=design.intercept), family, **more)


def gam(df: DataFrame, y: str, smooths: dict[str, int], family: str, strength: float = 1.0, **more) -> Fit:
    """Penalized B-splines: second differences of each smooth's coefficients are penalized in every IRLS step."""
    from gramlake.operators.terms import bs

    design = Design([y], [bs(c, n) for c, n in smooths.items()])
    k = 1 + sum(smooths.values())
    p, at = np.zeros((k, k)), 1
    for n in smooths.values():
        d = np.diff(np.eye(n), 2, axis=0)
        p[at : at + n, at : at + n] = strength * d.T @ d
        at += n
    return glm(df, design, family, penalty_matrix=p, **more)


# --- robust regression ---


def _psi(kind: str, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rho, weights psi(z) / z, and psi'(z)."""
    from gramlake.functions.columns import NORMS

    c, a = NORMS[kind], np.abs(z)
    if kind == "HuberT":
        inside = a <= c
        return np.where(inside, z * z / 2, c * a - c * c / 2), np.where(inside, 1, c / np.maximum(a, 1e-300)), inside.astype(float)
    if kind == "TukeyBiweight":
        u = np.where(a <= c, 1 - (z / c) ** 2, 0)
        return c * c / 6 * (1 - u**3), u * u, np.where(a <= c, u * (1 - 5 * (z / c) ** 2), 0)
    if kind == "TrimmedMean":
        inside = (a <= c).astype(float)
        return np.where(a <= c, z * z / 2, c * c / 2), inside, inside
    if kind == "AndrewWave":
        inside = a < c * math.pi
        t = np.where(inside, z / c, 0)
        w = np.where(inside, np.where(t == 0, 1, np.sin(t) / np.where(t == 0, 1, t)), 0)
        return np.where(inside, c * c * (1 - np.cos(t)), 2 * c * c), w, np.where(inside, np.cos(t), 0)
    if kind == "RamsayE":
        e = np.exp(-c * a)
        return (1 - e * (1 + c * a)) / (c * c), e, e * (1 - c * a)
    return z * z / 2, np.ones_like(z), np.ones_like(z)


def _psi_columns(kind: str, z: Column) -> tuple[Column, Column, Column]:
    """The same of a Column."""
    from gramlake.functions.columns import NORMS

    c, a, one, none = NORMS[kind], F.abs(z), F.lit(1.0), F.lit(0.0)
    if kind == "HuberT":
        return F.when(a <= c, z * z / 2).otherwise(c * a - c * c / 2), F.when(a <= c, one).otherwise(c / a), F.when(a <= c, one).otherwise(none)
    if kind == "TukeyBiweight":
        v = z / c * (z / c)
        u = F.when(a <= c, 1 - v).otherwise(none)
        return c * c / 6 * (1 - u * u * u), u * u, F.when(a <= c, u * (1 - 5 * v)).otherwise(none)
    if kind == "TrimmedMean":
        inside = F.when(a <= c, one).otherwise(none)
        return F.when(a <= c, z * z / 2).otherwise(c * c / 2), inside, inside
    if kind == "AndrewWave":
        end = c * math.pi
        return F.when(a < end, c * c * (1 - F.cos(z / c))).otherwise(2 * c * c), F.when(z == 0, one).when(a < end, F.sin(z / c) / (z / c)).otherwise(none), F.when(a < end, F.cos(z / c)).otherwise(none)
    if kind == "RamsayE":
        e = F.exp(-c * a)
        return (1 - e * (1 + c * a)) / (c * c), e, e * (1 - c * a)
    return z * z / 2, one, one


#: Residuals of a bracket that the driver sorts.
FEW = 20_000


def _residuals(rows: DataFrame, plan: Plan, betas: np.ndarray) -> DataFrame:
    """|y - X beta| of each fit as r0, r1, ..: expressions of a numeric design, a kernel's columns of one with dummies."""
    x = plan.plain()
    if x is not None:
        return rows.select(*[F.abs(_residual(x, b)).alias(f"r{i}") for i, b in enumerate(betas)])

    def kernel(batches):
        for whole in batches:
            for batch in (whole.slice(i, BLOCK_ROWS) for i in range(0, whole.num_rows, BLOCK_ROWS)):
                c = numpy_columns(batch)
                r = np.abs(plan.outcomes(c)[:, :1] - plan.matrix(c) @ betas.T)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in r.T], [f"r{i}" for i in range(len(betas))])

    return rows.mapInArrow(kernel, ", ".join(f"r{i} double" for i in range(len(betas))))


def _residual(x: list[Column], beta: np.ndarray) -> Column:
    out = F.col("y0")
    for c, b in zip(x, beta, strict=True):
        out = out - c * F.lit(float(b))
    return out


def _places(low: np.ndarray, high: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Brackets that differ, by their first rank, and which of them each rank has; both ranks of a fit mostly share theirs."""
    places, of = [], []
    for k in range(len(low)):
        if not (k % 2 and low[k] == low[k - 1] and high[k] == high[k - 1]):
            places.append(k)
        of.append(len(places) - 1)
    return places, np.array(of)


def _counts(rows: DataFrame, values: list[Column], most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Place, value and count of all values of some Columns, nulls left out; None where there are over ``most``."""
    if len(values) > 1:
        rows = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(values)])).alias("c")).select("c.i", "c.v")
    else:
        rows = rows.select(F.lit(0).alias("i"), values[0].alias("v"))
    found = rows.where("v is not null").groupBy("i", "v").agg(F.count("*").alias("n"))
    got = (found if most is None else found.limit(most + 1)).toArrow()
    return None if most is not None and got.num_rows > most else tuple(c.to_numpy() for c in got.columns)


def _median_abs(rows: DataFrame, plan: Plan, beta: np.ndarray, n: float, near: float = 0.0, spread: float = 0.5, seen: dict | None = None) -> float:
    """Median of |y - X beta|."""
    return float(_medians_abs(rows, plan, beta[None, :], n, near, spread, seen)[0])


def _medians_abs(rows: DataFrame, plan: Plan, betas: np.ndarray, n: float, near: float | np.ndarray = 0.0, spread: float = 0.5, seen: dict | None = None) -> np.ndarray:
    """Medians of |y - X beta| for several fits, by passes that count bins of shrinking brackets, for both middle ranks of all of them at once.

    The first bracket is ``near`` (one, or one for each fit) by ``spread`` on either side if the ranks lie in it, and powers of two otherwise. Of brackets
    with FEW residuals at most, these are counted value by value in one pass. ``seen`` keeps how dense they lie, so that a later call knows which brackets hold few.
    All counts are built-in aggregates; only a design with dummies takes its residuals from a kernel.
    """
    bins, m, seen = 4096, 2 * len(betas), {} if seen is None else seen
    ranks = np.tile([(n - 1) // 2, n // 2], len(betas))
    near = np.repeat(np.broadcast_to(near, len(betas)), 2)
    resid, r = _residuals(rows, plan, betas), [F.col(f"r{i}") for i in range(len(betas))]

    def closer(low, high):
        """The bins with the ranks, which were found, and how many residuals they hold; a rank outside its bracket keeps that."""
        width = np.maximum((high - low) / bins, 5e-324)
        places, of = _places(low, high)
        spans = [(r[k // 2] - F.lit(float(low[k]))) / F.lit(float(width[k])) for k in places]
        h = np.zeros((len(places), bins + 2))
        for i, v, count in zip(*_counts(resid, [F.floor(F.least(F.greatest(b, F.lit(-1.0)), F.lit(float(bins)))) for b in spans]), strict=True):
            h[i, int(v) + 1] = count
        h = h[of]
        below, total = h[:, 0], np.cumsum(h[:, 1:-1], axis=1) + h[:, :1]
        found = (below <= ranks) & (total[:, -1] > ranks)
        at = np.array([int(np.searchsorted(total[k], ranks[k], side="right")) for k in range(m)])
        held = np.where(found, h[np.arange(m), np.minimum(at, bins - 1) + 1], np.inf)
        if found.all():
            seen["density"] = float((held / width).max())
        return np.where(found, low + at * width, low), np.where(found, low + (at + 1) * width, high), found, held

    def among(low, high):
        """The ranks' values in brackets of few residuals; NaN where a bracket misses its rank, or where they hold more."""
        places, of = _places(low, high)
        got = _counts(resid, [F.when(r[k // 2] < float(low[k]), -1.0).when(r[k // 2] <= float(high[k]), r[k // 2]) for k in places], len(places) * (FEW + 1))
        out = np.full(m, np.nan)
        if got is not None:
            for k in range(m):
                mine = got[0] == of[k]
                order = np.argsort(got[1][mine])
                v, upto = got[1][mine][order], np.cumsum(got[2][mine][order])
                at = int(np.searchsorted(upto, ranks[k], side="right"))
                out[k] = v[at] if at < len(v) and v[at] >= 0 else np.nan
        return out

    if (near > 0).all() and "density" in seen:
        spread = max(spread, 100 / max(seen["density"] * near.min(), 1e-300))  # wide enough for some ranks on either side
        if 2 * spread * near.max() * seen["density"] <= FEW / 4 and spread < 1:
            exact = among(near * (1 - spread), near * (1 + spread))
            if not np.isnan(exact).any():
                return exact.reshape(-1, 2).mean(axis=1)
            spread = 0.5
        spread = min(spread, 0.5)
    low, high, found, held = closer(near * (1 - spread), near * (1 + spread)) if (near > 0).all() else (None, None, np.zeros(m, bool), None)
    if not found.all():

        powers = []  # of two first
        for c in r:
            v = F.greatest(c, F.lit(1e-300))
            e = F.floor(F.least(F.log2(v), F.lit(1023.0)))
            one = v * F.pow(F.lit(2.0), -e)  # from 1 to 2, but that logarithms round
            powers.append(e + F.when(one >= 2, 1).when(one < 1, -1).otherwise(0))
        each = np.zeros((len(betas), 2048))
        for i, v, count in zip(*_counts(resid, powers), strict=True):
            each[i, min(max(int(v) + 1024, 0), 2047)] += count
        each = np.repeat(each, 2, axis=0)
        at = np.array([int(np.searchsorted(u, rank, side="right")) for u, rank in zip(np.cumsum(each, axis=1), ranks, strict=True)])
        low, high, held = np.where(at > 0, 2.0 ** (at - 1024.0), 0.0), 2.0 ** (at - 1023.0), each[np.arange(m), at]
    for _ in range(5):
        if (high - low < 1e-13 * np.maximum(high, 1e-300)).all():
            break
        if (held <= FEW / 2).all():
            edge = 1e-3 * (high - low) + 1e-15 * high  # bins and comparisons round differently
            exact = among(low - edge, high + edge)
            if not np.isnan(exact).any():
                return exact.reshape(-1, 2).mean(axis=1)
        low, high, found, held = closer(low, high)  # a bracket as fine as its numbers: rounding moves ranks out of it
        if not found.any():
            break
    return ((low + high) / 2).reshape(-1, 2).mean(axis=1)


def _rises(xwx: np.ndarray, xdx: np.ndarray) -> bool:
    """Whether psi' keeps a tenth of the weights at least in every direction."""
    d = np.sqrt(np.maximum(np.diag(xwx), 1e-300))
    try:
        inner = np.linalg.inv(np.linalg.cholesky(xwx / np.outer(d, d)))
    except np.linalg.LinAlgError:
        return False
    return bool(np.linalg.eigvalsh(inner @ (xdx / np.outer(d, d)) @ inner.T)[0] >= 0.1)


#: Columns of a numeric design up to which robust fits add up built-in sums; wider ones and dummies take the kernel.
BUILT_IN = 8


def _robust_step(rows: DataFrame, plan: Plan, norm: str, beta: np.ndarray | None, s: float | None) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, X'WX, X'DX and X'Wy with the weights and slopes of residuals over ``s``; without ``beta``, of least squares."""
    k, x = len(plan.names), plan.plain()
    if x is not None and k <= BUILT_IN:
        _, weight, slope = _psi_columns(norm, F.col("_r") / F.lit(float(s))) if beta is not None else (None, F.lit(1.0), F.lit(0.0))
        known = rows.select(*[c.alias(f"_x{i}") for i, c in enumerate(x)], "w", _residual(x, np.zeros(k) if beta is None else beta).alias("_r"))
        known = known.select(*[f"_x{i}" for i in range(k)], "_r", (F.col("w") * weight).alias("_w"), (F.col("w") * slope).alias("_d"))
        xs = [F.col(f"_x{i}") for i in range(k)]
        t = sum_columns(known, [F.lit(1.0), *_products(xs, F.col("_w")), *_products(xs, F.col("_d")), *[c * F.col("_w") * F.col("_r") for c in xs]])
        half = k * (k + 1) // 2
        xwx, xdx, xwr = _symmetric(t[1 : 1 + half], k), _symmetric(t[1 + half : 1 + 2 * half], k), t[1 + 2 * half :]
        return t[0], xwx, xdx, xwr if beta is None else xwr + xwx @ beta  # scores cancel as they add up, and round less than X'Wy

    def step(c):
        x, y, w = plan.matrix(c), plan.outcomes(c)[:, 0], c["w"]
        d = np.zeros_like(w)
        if beta is not None:
            _, weight, slope = _psi(norm, (y - x @ beta) / s)
            w, d = w * weight, w * slope
        xw = x * w[:, None]
        return np.concatenate([[len(x)], (x.T @ xw).ravel(), (x.T @ (x * d[:, None])).ravel(), xw.T @ y])

    t = sum_rows(rows, step)
    if not len(t):
        raise ValueError("no valid rows")
    return t[0], t[1 : 1 + k * k].reshape(k, k), t[1 + k * k : 1 + 2 * k * k].reshape(k, k), t[1 + 2 * k * k :]


def _robust_last(rows: DataFrame, plan: Plan, norm: str, beta: np.ndarray, s: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums of rho, psi^2, psi' and psi'^2; X'X, X'DX and that of the scores."""
    k, x = len(plan.names), plan.plain()
    if x is not None and k <= BUILT_IN:
        rho, weight, slope = _psi_columns(norm, F.col("_z"))
        known = rows.select(*[c.alias(f"_x{i}") for i, c in enumerate(x)], (_residual(x, beta) / F.lit(float(s))).alias("_z"))
        known = known.select(*[f"_x{i}" for i in range(k)], rho.alias("_rho"), (weight * F.col("_z")).alias("_psi"), slope.alias("_d"))
        xs, psi, d = [F.col(f"_x{i}") for i in range(k)], F.col("_psi"), F.col("_d")
        t = sum_columns(known, [F.col("_rho"), psi * psi, d, d * d, *_products(xs, F.lit(1.0)), *_products(xs, d), *_products(xs, psi * psi)])
        return t[:4], *(_symmetric(v, k) for v in t[4:].reshape(3, -1))

    def final(c):
        x, y = plan.matrix(c), plan.outcomes(c)[:, 0]
        z = (y - x @ beta) / s
        rho, w, d = _psi(norm, z)
        psi = w * z
        return np.concatenate([[rho.sum(), (psi * psi).sum(), d.sum(), (d * d).sum()], (x.T @ x).ravel(), (x.T @ (x * d[:, None])).ravel(), ((x * psi[:, None]).T @ (x * psi[:, None])).ravel()])

    t = sum_rows(rows, final)
    return t[:4], *t[4:].reshape(3, k, k)


def _products(x: list[Column], w: Column) -> list[Column]:
    """Upper half of x x' w."""
    return [x[i] * x[j] * w for i in range(len(x)) for j in range(i, len(x))]


def _symmetric(half: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = half
    return out + np.triu(out, 1).T


def rlm(df: DataFrame, design: Design, norm: str = "HuberT", cov_type: str = "H1", scale: float | None = None, max_iter: int = 50, tol: float = 1e-6) -> Fit:
    """M-estimation by IRLS with the MAD scale of each step, from counting passes over a cached projection.

    Near the solution, where steps lie well within the scale and psi rises on the whole, Newton's steps replace those of IRLS as long as they shrink by half.
    The fit's ``covariances`` has the matrices of all kinds, which cost no further pass.
    """
    plan = whole = design.fit(df)
    rows = plan.rows(df).persist(StorageLevel.MEMORY_AND_DISK)
    k, beta, s, median, spread = len(plan.names), None, scale, 0.0, 0.5
    change, fast, seen = math.inf, True, {}
    try:
        moved = centred(rows, plan)
        plan = moved.plan
        for iteration in range(max_iter):
            n, xwx, xdx, xwy = _robust_step(rows, plan, norm, beta, s)
            if not n:
                raise ValueError("no valid rows")
            new, _ = solve_scaled(xwx, xwy)
            newton = beta is not None and fast and _rises(xwx, xdx) and math.sqrt(max((new - beta) @ xwx @ (new - beta), 0.0) / n) < 0.1 * s
            if newton:
                new = beta + solve_scaled(xdx, xwx @ (new - beta))[0]
            last, change = change, np.max(np.abs(new - beta) / np.maximum(1, np.abs(new))) if beta is not None else math.inf
            fast = fast and not (newton and change > last / 2)
            rounding = beta is not None and change >= last and math.sqrt(max((new - beta) @ xwx @ (new - beta), 0.0)) < ROUNDING * s
            beta = new
            if scale is None:
                before, median = median, _median_abs(rows, plan, beta, n, median, spread, seen)
                spread = min(0.5, max(1e-7, 20 * abs(median - before) / max(median, 1e-300)))
                s = median / special.norm_ppf(0.75)
                if s <= 0:
                    raise ValueError("more than half of the residuals are 0: there is no scale")
            if change < tol or rounding:
                break
        t, xx, xdx, meat = _robust_last(rows, plan, norm, beta, s)
    finally:
        rows.unpersist()
    m, var = t[2] / n, t[3] / n - (t[2] / n) ** 2
    kk, dfr = 1 + k / n * var / (m * m), n - k
    inv = solve_scaled(xx, np.zeros(k))[1]
    winv = solve_scaled(xdx, np.zeros(k))[1]
    psi2 = t[1] * s * s / dfr
    cov = {"H1": kk**2 * psi2 / m**2 * inv, "H2": kk * psi2 / m * winv, "H3": psi2 / kk * winv @ xx @ winv, "SANDWICH": winv @ meat @ winv * s * s * n / dfr}
    fit = moved.fit(Fit(plan.names, beta, cov[cov_type], dfr, {"n": n, "scale": s, "cost": t[0], "iterations": iteration + 1, "converged": iteration + 1 < max_iter, "df_resid": dfr}, inv, plan, use_t=False), whole)
    fit.covariances = {kind: moved.back @ v @ moved.back.T for kind, v in cov.items()}
    return fit


def row_weights(fit: Fit, df: DataFrame, norm: str, name: str = "weight") -> DataFrame:
    """Robust weight psi(z) / z of every row, as an expression."""
    from gramlake.functions.columns import robust_weight

    hat = fit.plan.predictions(df, fit.params, "_hat")
    z = (F.expr(fit.plan.design.y[0]) - F.col("_hat")) / F.lit(float(fit.stats["scale"]))
    return hat.withColumn(name, robust_weight(norm, z)).drop("_hat")


# --- quantile regression ---


#: Rows of the sample that quantile fits start from.
START_ROWS = 20_000


def quantile_regression(df: DataFrame, design: Design, taus: list[float], cov_type: str | None = "IID", k: float = 1e-5, max_iter: int = 200, xtol: float = 1e-6, ftol: float = 1e-8) -> dict[float, Fit]:
    """IRLS on the smoothed check loss, all quantiles in the same pass; a step along each direction is chosen on a grid in another pass.

    Steps start from the fit of a sample of about START_ROWS rows on the driver, which Newton's steps over all rows draw nearer; all that is returned is of all rows. The
    start, and where that lies too far off what the steps over all rows end at, is carried on to the exact minimum, a fit through as many rows as columns, which is proven for all rows where ``exact`` says so (``checkloss``). The residuals' weights are those of a Huber-like surrogate with |z| cut at 1e-10, relative to the outcome's deviation.
    ``cov_type`` None gives no covariance and no density, which saves the passes for residuals' medians.
    """
    steps = np.array([0.05, 0.25, 0.5, 1, 1.5, 3, 5, 10, 20])
    plan = whole = design.fit(df)
    rows = plan.rows(df).persist(StorageLevel.MEMORY_AND_DISK)
    p, q = len(plan.names), len(taus)
    tau = np.array(taus)
    check = lambda r, t: r * (t - (r < 0))
    try:
        moved = centred(rows, plan)
        plan = moved.plan

        def start(c):
            x, y = plan.matrix(c), plan.outcomes(c)[:, 0] - moved.y[0]
            return np.concatenate([[len(x), y.sum(), (y * y).sum()], (x.T @ (x * c["w"][:, None])).ravel(), x.T @ (y * c["w"])])

        s = sum_rows(rows, start)
        n, sd = s[0], math.sqrt(max(s[2] / s[0] - (s[1] / s[0]) ** 2, 1e-300))
        beta = np.tile(solve_scaled(s[3 : 3 + p * p].reshape(p, p), s[3 + p * p :])[0], (q, 1))
        beta[:, :1] += moved.y[0]
        weighed = s[3 : 3 + p * p].reshape(p, p)
        used = np.diag(solve_scaled(weighed, s[3 + p * p :])[1]) != 0

        def descend(total, beta):
            """Steps until no quantile moves; ``total`` sums a kernel over the rows."""
            done = np.zeros(q, bool)
            for iteration in range(max_iter):

                def gram(c, beta=beta):
                    x, y = plan.matrix(c), plan.outcomes(c)[:, 0]
                    out = []
                    for b, t in zip(beta, tau, strict=True):
                        z = (y - x @ b) / sd
                        a = np.where(z >= 0, t, 1 - t)
                        w = c["w"] * a * np.where(np.abs(z) < k, 1 / k, 1 / np.maximum(np.abs(z), 1e-10))
                        xw = x * w[:, None]
                        out += [(x.T @ xw).ravel(), xw.T @ y]
                    return np.concatenate(out)

                s = total(gram).reshape(q, p * p + p)
                direction = np.stack([solve_scaled(v[: p * p].reshape(p, p), v[p * p :])[0] - b for v, b in zip(s, beta, strict=True)])

                def costs(c, beta=beta, direction=direction):
                    x, y = plan.matrix(c), plan.outcomes(c)[:, 0]
                    r, d = y[:, None] - x @ beta.T, x @ direction.T
                    return np.stack([(c["w"][:, None] * check(r - h * d, tau)).sum(0) for h in [0.0, *steps]])

                v = np.asarray(total(costs)).reshape(len(steps) + 1, q)
                best = v.argmin(axis=0)
                move = np.where(best > 0, np.concatenate([[0.0], steps])[best], 0.0)
                new = beta + move[:, None] * direction * ~done[:, None]
                change = np.max(np.abs(new - beta) / np.maximum(1, np.abs(new)), axis=1)
                done |= (change < xtol) | (v[0] - v.min(axis=0) < ftol * np.maximum(1e-300, v[0]))
                beta = new
                if done.all():
                    break
            return beta, v.min(axis=0), iteration

        # the start for the passes over all rows: a fit of a bounded sample
        some = rows.sample(False, min(1.0, START_ROWS / n), 1).limit(2 * START_ROWS).toArrow().combine_chunks()
        if some.num_rows > 10 * p:
            columns = numpy_columns(some.to_batches()[0])
            beta, _, _ = descend(lambda f: np.asarray(f(columns)).ravel(), beta)
        half, middle = np.zeros(q), np.zeros(q)
        if some.num_rows > 10 * p and n > band_rows(p, q):
            middle = np.median(np.abs(plan.outcomes(columns)[:, :1] - plan.matrix(columns) @ beta.T), axis=0)
            beta, half = nearer(rows, plan, beta, tau, used, n, weighed, np.maximum(0.9 * middle / special.norm_ppf(0.75) * some.num_rows**-0.2, 1e-12 * sd))
        beta, exact = settle(rows, plan, beta, tau, used, n, 2, half)
        iteration = 0
        if not exact.all():  # the sample's fit lies too far off: steps over all rows lead nearer
            near, _, iteration = descend(lambda f: sum_rows(rows, f), beta)
            near, proven = settle(rows, plan, near, tau, used, n)
            beta, exact = np.where(exact[:, None], beta, near), exact | proven
        h = np.full(q, np.inf)
        if cov_type is not None:
            h = np.maximum(0.9 * _medians_abs(rows, plan, beta, n, middle, 0.05) / special.norm_ppf(0.75) * n**-0.2, 1e-12)

        def density(c):
            x, y = plan.matrix(c), plan.outcomes(c)[:, 0]
            out = []
            for b, t, one in zip(beta, tau, h, strict=True):
                r = y - x @ b
                r = np.where(np.abs(r) < 1e-10 * sd, 0.0, r)  # rows on the fit
                f = np.exp(-0.5 * (r / one) ** 2) / (one * math.sqrt(2 * math.pi))
                d = np.where(r >= 0, t, 1 - t)
                out += [[f.sum(), (r < 0).sum(), check(r, t).sum()], (x.T @ x).ravel(), (x.T @ (x * f[:, None])).ravel(), (x.T @ (x * d[:, None])).ravel()]
            return np.concatenate(out)

        fits = {}
        for b, t, sure, s in zip(beta, taus, exact, sum_rows(rows, density).reshape(q, 3 + 3 * p * p), strict=True):
            f0, xx, xfx, xdx = s[0] / n, *(s[3 + i * p * p : 3 + (i + 1) * p * p].reshape(p, p) for i in range(3))
            inv = solve_scaled(xx, np.zeros(p))[1]
            if cov_type is None:
                f0, cov = math.nan, np.full((p, p), math.nan)
            elif cov_type == "IID":
                cov = t * (1 - t) / (f0 * f0) * inv
            else:
                w = solve_scaled(xfx, np.zeros(p))[1]
                cov = w @ xdx @ w
            fits[t] = moved.fit(Fit(plan.names, b, cov, n - p, {"n": n, "cost": float(s[2]), "exact": bool(sure), "share_below": s[1] / n, "sparsity_density": f0, "iterations": iteration + 1, "converged": bool(sure) or iteration + 1 < max_iter, "df_resid": n - p}, inv, plan), whole)
        return fits
    finally:
        rows.unpersist()


def pseudo_r1(df: DataFrame, y: str, tau: float, cost: float) -> float:
    """1 - check cost over that of the unconditional quantile."""
    from gramlake.operators.aggregates import exact_quantile

    v = F.col(y).cast("double")
    q = exact_quantile(df, v, tau)
    r = v - F.lit(q)
    return 1 - cost / df.agg(F.sum(r * (F.lit(tau) - (r < 0).cast("int")))).first()[0]


def quantile_control_function(df: DataFrame, design: Design, endogenous: str, taus: list[float], order: int = 1, **more) -> dict[float, Fit]:
    """Quantile regression with first-stage residuals of ``endogenous`` on the instruments as further terms, powers 1..order."""
    from gramlake.operators.linear import ols
    from gramlake.operators.terms import poly

    first = ols(df, Design([endogenous], design.instruments, weights=design.weights))
    with_fit = first.plan.predictions(df, first.params, "_hat")
    rows = with_fit.withColumn("_resid", F.col(endogenous) - F.col("_hat"))
    return quantile_regression(rows, Design(design.y, [*design.x, poly("_resid", order)], weights=design.weights, intercept=design.intercept), taus, **more)
