"""Count, positive and two-part models by maximum likelihood.

A row's likelihood depends on the parameters through a few scalars only: the linear predictors and one
shape. Each Newton step is one pass: derivatives by these scalars are vectorized differences, and the
chain rule with the design gives the score, the Hessian and the outer product of scores.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.functions.special import gammaln
from gramlake.operators.linear import Fit, centred
from gramlake.operators.rows import sum_rows
from gramlake.operators.state import held
from gramlake.operators.terms import Design


def _log1pexp(z):
    return np.logaddexp(0, z)


def _poisson(y, eta):
    return y * eta - np.exp(np.minimum(eta, 50)) - gammaln(y + 1)


def _nb2(y, eta, la):
    if np.max(la) <= math.log(1e-8):
        return _poisson(y, eta)
    size, z = np.exp(-la), eta + la
    return gammaln(y + size) - gammaln(size) - gammaln(y + 1) - size * _log1pexp(z) + y * (z - _log1pexp(z))


def _nb1(y, eta, la):
    if np.max(la) <= math.log(1e-8):
        return _poisson(y, eta)
    size, lg = np.exp(np.minimum(eta, 50) - la), _log1pexp(la)
    return gammaln(y + size) - gammaln(size) - gammaln(y + 1) - size * lg + y * (la - lg)


def _gp(p):
    def llf(y, eta, a):
        mu = np.exp(np.minimum(eta, 50))
        m = mu ** (p - 1)
        a1, a2 = 1 + a * m, mu + a * m * y
        ok = (a1 > 0) & (a2 > 0)
        a1, a2 = np.where(ok, a1, 1), np.where(ok, a2, 1)
        return np.where(ok, eta + (y - 1) * np.log(a2) - y * np.log(a1) - gammaln(y + 1) - a2 / a1, -1e6)

    return llf


def _gamma(y, eta, la):
    s = np.exp(-la)
    return s * np.log(s) - gammaln(s) + (s - 1) * np.log(y) - s * eta - s * y * np.exp(-eta)


def _inflated(base):
    """Zero inflation: the second linear predictor is the logit of an extra zero."""

    def llf(y, eta, infl, *rest):
        f0 = base(np.zeros_like(y), eta, *rest)
        zero = np.logaddexp(infl, f0) - _log1pexp(infl)
        return np.where(y == 0, zero, -_log1pexp(infl) + base(y, eta, *rest))

    return llf


def _truncated(base):
    """Zero-truncated count."""
    return lambda y, eta, *rest: base(y, eta, *rest) - np.log(-np.expm1(np.minimum(base(np.zeros_like(y), eta, *rest), -1e-12)))


def _lognormal(y, eta, ls):
    return -np.log(y) - ls - 0.5 * math.log(2 * math.pi) - 0.5 * ((np.log(y) - eta) / np.exp(ls)) ** 2


def _gaussian(y, eta, ls):
    return -ls - 0.5 * math.log(2 * math.pi) - 0.5 * ((y - eta) / np.exp(ls)) ** 2


def _inverse_gaussian(y, eta, ls):
    mu, lam = np.exp(eta), np.exp(-ls)
    return 0.5 * (np.log(lam) - math.log(2 * math.pi) - 3 * np.log(y)) - lam * (y - mu) ** 2 / (2 * mu * mu * y)


def _logit(y, eta):
    return y * eta - _log1pexp(eta)


#: Likelihood, whether it has an inflation predictor, the shape's name or none, and the support.
MODELS = {
    "poisson": (_poisson, False, None, "count"),
    "nb2": (_nb2, False, "log_alpha", "count"),
    "nb1": (_nb1, False, "log_alpha", "count"),
    "gp1": (_gp(1), False, "alpha", "count"),
    "gp2": (_gp(2), False, "alpha", "count"),
    "gamma": (_gamma, False, "log_alpha", "positive"),
    "zip": (_inflated(_poisson), True, None, "count"),
    "zinb": (_inflated(_nb2), True, "log_alpha", "count"),
    "zt_poisson": (_truncated(_poisson), False, None, "positive count"),
    "zt_nb2": (_truncated(_nb2), False, "log_alpha", "positive count"),
    "lognormal": (_lognormal, False, "log_sigma", "positive"),
    "gaussian": (_gaussian, False, "log_sigma", "any"),
    "inverse_gaussian": (_inverse_gaussian, False, "log_lambda", "positive"),
    "logit": (_logit, False, None, "binary"),
}


def check_support(df: DataFrame, y: str, kind: str) -> None:
    """One aggregate; a clear error where the outcome doesn't fit the model."""
    v = F.col(y)
    bad = {"count": (v < 0) | (v != F.floor(v)), "positive": v <= 0, "positive count": (v < 1) | (v != F.floor(v)), "binary": ~v.isin(0.0, 1.0), "any": F.lit(False)}[kind]
    if df.agg(F.max(bad.cast("int"))).first()[0]:
        raise ValueError(f"the outcome must be {kind}")


def _derivatives(llf, y, scalars, small=1e-3, h=3e-3):
    """Value, gradient (n x m) and Hessian (n x m x m) by differences in the scalars: of fourth order for the gradient, wide ones for the Hessian, whose rounding error they divide by h squared."""
    m = len(scalars)

    def at(*shift):
        return llf(y, *[s + shift[i] for i, s in enumerate(scalars)])

    zero = [0.0] * m
    f = at(*zero)
    grad, hess = np.empty((len(y), m)), np.empty((len(y), m, m))
    for i in range(m):
        up, down = list(zero), list(zero)
        one, two = [], []
        for shift, out in ((small, one), (2 * small, two)):
            up[i], down[i] = shift, -shift
            out.append(at(*up) - at(*down))
        grad[:, i] = (8 * one[0] - two[0]) / (12 * small)
        up[i], down[i] = h, -h
        hess[:, i, i] = (at(*up) - 2 * f + at(*down)) / (h * h)
        for j in range(i):
            pp, pm, mp, mm = ([*zero] for _ in range(4))
            pp[i] = pm[i] = mp[j] = pp[j] = h
            mp[i] = mm[i] = pm[j] = mm[j] = -h
            hess[:, i, j] = hess[:, j, i] = (at(*pp) - at(*pm) - at(*mp) + at(*mm)) / (4 * h * h)
    return f, grad, hess


def fit_mle(df: DataFrame, design: Design, model: str, inflation: Design | None = None, cov_type: str = "SANDWICH", max_iter: int = 100, tol: float = 1e-8) -> Fit:
    """Newton with step halving (several halvings tried in one pass) over a cached projection. The shape starts at 0, the mean at the intercept.

    cov_type SANDWICH or NONROBUST. Parameters: x terms, then inflate_ terms, then the shape.
    """
    llf, inflated, shape, support = MODELS[model]
    plan = design.fit(df)
    both = Design(design.y, design.x, weights=design.weights, intercept=design.intercept)
    infl = Design([], (inflation or Design([], [])).x, intercept=True) if inflated else None
    plan2 = infl.fit(df) if infl else None
    rows = plan.rows(df) if not infl else _joint_rows(plan, plan2, df.where(both.valid(df) & infl.valid(df)))
    rows = held(rows)
    try:
        check_support(rows, "y0", support)
        moved = centred(rows, plan)
        k1, k2 = len(plan.names), len(plan2.names) if plan2 else 0
        k = k1 + k2 + bool(shape)
        mean, n = rows.agg(F.avg("y0"), F.count("*")).first()
        if not n:
            raise ValueError("no valid rows")
        theta = np.zeros(k)
        if design.intercept:
            theta[0] = mean if model == "gaussian" else 0.0 if model == "logit" else math.log(max(mean, 1e-3))
        if inflated:
            theta[k1] = -1.0
        if shape == "alpha":
            theta[-1] = 0.01

        def blocks(c):
            x2 = plan2.matrix({a.removeprefix("i_"): v for a, v in c.items() if a.startswith("i_")} | {"w": c["w"]}) if plan2 else None
            return moved.plan.matrix(c), x2, c["y0"], c["w"]

        def scalars(x1, x2, t, size):
            out = [x1 @ t[:k1]]
            if x2 is not None:
                out.append(x2 @ t[k1 : k1 + k2])
            if shape:
                out.append(np.full(size, t[-1]))
            return out

        def newton(c, t):
            x1, x2, y, w = blocks(c)
            f, g, h = _derivatives(llf, y, scalars(x1, x2, t, len(y)))
            parts = [x1] + ([x2] if x2 is not None else []) + ([np.ones((len(y), 1))] if shape else [])
            score = np.concatenate([p * g[:, [i]] for i, p in enumerate(parts)], 1)
            hess = np.block([[a.T @ (b * (w * h[:, i, j])[:, None]) for j, b in enumerate(parts)] for i, a in enumerate(parts)])
            return np.concatenate([[(w * f).sum()], score.T @ w, hess.ravel(), (score.T @ (score * (w * w)[:, None])).ravel()])

        flat = 0
        for iteration in range(max_iter):
            s = sum_rows(rows, lambda c, t=theta: newton(c, t))
            value, grad, hess, outer = s[0], s[1 : 1 + k], s[1 + k : 1 + k + k * k].reshape(k, k), s[1 + k + k * k :].reshape(k, k)
            eig, vec = np.linalg.eigh(-hess)
            step = vec @ ((vec.T @ grad) / np.maximum(np.abs(eig), 1e-8 * max(np.abs(eig).max(), 1e-8)))
            step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
            if np.max(np.abs(step)) < tol * max(1.0, np.max(np.abs(theta))):
                break
            sizes = 0.5 ** np.arange(6)

            def values(c, t=theta, step=step):
                x1, x2, y, w = blocks(c)
                with np.errstate(all="ignore"):
                    return np.array([np.nan_to_num((w * llf(y, *scalars(x1, x2, t + a * step, len(y)))).sum(), nan=-1e300, neginf=-1e300) for a in sizes])

            v = sum_rows(rows, values)
            slack = 1e-11 * max(1.0, abs(value))
            if v.max() < value - slack:
                break
            theta = theta + sizes[int(np.argmax(v >= v.max() - slack))] * step  # the longest of equally good steps
            flat = flat + 1 if v.max() - value < 1e-9 * abs(value) else 0
            if flat > 1:  # twice, as where a shape runs off to its bound
                break
    finally:
        rows.unpersist()
    inv = np.linalg.pinv(-hess)
    back = np.eye(k)
    back[:k1, :k1] = moved.back
    theta, cov, inv = back @ theta, back @ (inv @ outer @ inv if cov_type == "SANDWICH" else inv) @ back.T, back @ inv @ back.T
    names = plan.names + ([f"inflate_{x}" for x in plan2.names] if plan2 else []) + ([shape] if shape else [])
    fit = Fit(names, theta, cov, n - k, {"n": n, "llf": float(value), "aic": -2 * value + 2 * k, "bic": -2 * value + k * math.log(n), "iterations": iteration + 1, "converged": iteration + 1 < max_iter, "df_resid": n - k}, inv, plan, use_t=False)
    fit.model, fit.plan2, fit.sizes = model, plan2, (k1, k2)
    return fit


def _joint_rows(plan, plan2, df: DataFrame) -> DataFrame:
    """One projection that holds both designs."""
    with_b = plan2.rows(df, keep=[F.struct("*").alias("_row")], valid_only=False)
    names = [c for c in with_b.columns if c not in ("_row", "w")]
    back = with_b.select("_row.*", *[F.col(c).alias(f"i_{c}") for c in names])
    return plan.rows(back, keep=[f"i_{c}" for c in names], valid_only=False)


def hurdle(df: DataFrame, y: str, x: list, positive: str, zero_x: list | None = None) -> dict[str, Fit]:
    """Two separable parts: a logit for y > 0 on all rows, and the positive part's model on the rows with y > 0.

    ``positive`` is zt_poisson, zt_nb2, gamma, lognormal, gaussian or inverse_gaussian. Both zeros and positives must occur.
    """
    seen = df.agg(F.max((F.col(y) == 0).cast("int")), F.max((F.col(y) > 0).cast("int"))).first()
    if not (seen[0] and seen[1]):
        raise ValueError("a hurdle needs zeros and positive outcomes")
    marked = df.withColumn("_positive", (F.col(y) > 0).cast("double"))
    return {"zero": fit_mle(marked, Design(["_positive"], zero_x if zero_x is not None else x), "logit"), "positive": fit_mle(df.where(F.col(y) > 0), Design([y], x), positive)}


def predict_mean(fit: Fit, df: DataFrame, name: str = "mean") -> DataFrame:
    """The mean of the fitted model as columns; zero inflation scales it down."""
    k1, k2 = fit.sizes
    link: dict[str, object] = {"gaussian": lambda e: e, "logit": lambda e: 1 / (1 + F.exp(-e)), "lognormal": lambda e: F.exp(e + F.lit(0.5 * math.exp(2 * float(fit.params[-1]))))}
    out = fit.plan.predictions(df, fit.params[:k1], name, link.get(fit.model, F.exp))
    if fit.plan2 is not None:
        out = fit.plan2.predictions(out, fit.params[k1 : k1 + k2], "_infl", lambda e: 1 / (1 + F.exp(-e)))
        out = out.withColumn(name, F.col(name) * (1 - F.col("_infl"))).drop("_infl")
    if fit.model.startswith("zt_"):
        zero = F.exp(-F.col(name)) if fit.model == "zt_poisson" else F.pow(1 + F.exp(F.lit(float(fit.params[-1]))) * F.col(name), -F.exp(F.lit(-float(fit.params[-1]))))
        out = out.withColumn(name, F.col(name) / (1 - zero))
    return out


def predict_zero(fit: Fit, df: DataFrame, name: str = "p_zero") -> DataFrame:
    """Probability of a zero under a Poisson, NB2 or zero-inflated fit, as an expression."""
    k1, k2 = fit.sizes
    base = fit.model.replace("zip", "poisson").replace("zinb", "nb2")
    out = fit.plan.predictions(df, fit.params[:k1], "_mu", F.exp)
    if base == "poisson":
        zero = F.exp(-F.col("_mu"))
    elif base == "nb2":
        size = math.exp(-float(fit.params[-1]))
        zero = F.pow(1 + F.col("_mu") / size, F.lit(-size))
    else:
        raise ValueError(f"no zero probability for {fit.model}")
    out = out.withColumn(name, zero)
    if fit.plan2 is not None:
        out = fit.plan2.predictions(out, fit.params[k1 : k1 + k2], "_infl", lambda e: 1 / (1 + F.exp(-e)))
        out = out.withColumn(name, F.col("_infl") + (1 - F.col("_infl")) * F.col(name)).drop("_infl")
    return out.drop("_mu")


def hurdle_mean(fits: dict[str, Fit], df: DataFrame, name: str = "mean") -> DataFrame:
    """P(y > 0) times the mean of the positive part."""
    out = predict_mean(fits["zero"], df, "_p")
    out = predict_mean(fits["positive"], out, "_m")
    return out.withColumn(name, F.col("_p") * F.col("_m")).drop("_p", "_m")


def average_effect(fit: Fit, df: DataFrame, column: str, secant: bool = False, weight: str | None = None) -> tuple[float, float]:
    """Mean change of the predicted mean for a unit of a numeric column (or from 0 to 1), and its error. One aggregate."""
    from gramlake.operators.effects import average_effects

    return average_effects(fit, df, [column], predict_mean, (column,) if secant else (), weight=weight)[column]
