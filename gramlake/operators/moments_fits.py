"""Fits by moments and by nonlinear least squares, and partial least squares: passes of sums over rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.functions.special import chi2_sf
from gramlake.operators.linear import Fit, centred_gram, solve_scaled
from gramlake.operators.rows import sum_rows, sum_rows_by
from gramlake.operators.terms import Design


def gmm_iv_linear(df: DataFrame, design: Design, method: str = "TWO_STEP", start: str = "2SLS", iterations: int = 20) -> Fit:
    """Moments z (y - x'b): ONE_STEP, TWO_STEP or ITERATIVE weights. One pass for the sums, one for each weight matrix.

    The weight is the inverse of the uncentred mean of g g'; the covariance is the sandwich; J tests over-identification.
    """
    plan = whole = design.fit(df)
    rows = plan.rows(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        moved, g = centred_gram(rows, plan)
        plan = moved.plan
        n, q = g.n, len(plan.z_names)
        w = np.linalg.inv(g.zz / n) if start == "2SLS" else np.eye(q)

        def solve(w):
            a = g.zx.T @ w @ g.zx
            return solve_scaled((a + a.T) / 2, g.zx.T @ w @ g.zy[:, 0])[0]

        def omega(b):
            def kernel(c):
                m = plan.matrix(c, "z") * (c["w"] * (plan.outcomes(c)[:, 0] - moved.y[0] - plan.matrix(c) @ b))[:, None]
                return m.T @ m

            return sum_rows(rows, kernel).reshape(q, q) / n

        beta = solve(w)
        rounds = {"ONE_STEP": 0, "TWO_STEP": 1}.get(method, iterations)
        for _ in range(rounds):
            w = np.linalg.inv(omega(beta))
            new = solve(w)
            small = np.max(np.abs(new - beta)) < 1e-10 * max(1.0, np.max(np.abs(new)))
            beta = new
            if small:
                break
        om = omega(beta)
    finally:
        rows.unpersist()
    d = -g.zx / n
    bread = np.linalg.inv(d.T @ w @ d)
    cov = bread @ d.T @ w @ om @ w @ d @ bread / n
    mean = (g.zy[:, 0] - g.zx @ beta) / n
    over = q - len(beta)
    j = float(n * mean @ w @ mean)
    beta[:1] += moved.y[0]
    return moved.fit(Fit(plan.names, beta, cov, n - len(beta), {"n": n, "j": j, "j_p": float(chi2_sf(j, over)) if over > 0 else math.nan, "df_resid": n - len(beta)}, bread, plan, use_t=False), whole)


def gmm(df: DataFrame, columns: list[str], moments: Callable, start: np.ndarray, method: str = "TWO_STEP", cluster: str | None = None, max_iter: int = 100, tol: float = 1e-9) -> Fit:
    """Any moment function ``moments(columns, theta) -> rows x q``, vectorized over a block of rows.

    Gauss-Newton on the weighted mean moments; means, Jacobian (central differences) and the mean of g g'
    come from one pass a step. With ``cluster`` the last covariance sums moments within clusters first.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns], *([F.col(cluster).cast("string").alias("_g")] if cluster else [])).na.drop().persist(StorageLevel.MEMORY_AND_DISK)
    theta = np.asarray(start, float)
    p = len(theta)
    try:

        def kernel(c, t):
            m = np.asarray(moments(c, t), float)
            out = [[len(m)], m.sum(0)]
            for i in range(p):
                h = 1e-6 * max(1.0, abs(t[i]))
                e = np.zeros(p)
                e[i] = h
                out.append((np.asarray(moments(c, t + e)) - np.asarray(moments(c, t - e))).sum(0) / (2 * h))
            return np.concatenate([*out, (m.T @ m).ravel()])

        def at(t):
            s = sum_rows(rows, lambda c: kernel(c, t))
            n = s[0]
            q = int(round((-(1 + p) + math.sqrt((1 + p) ** 2 + 4 * (len(s) - 1))) / 2))
            return n, s[1 : 1 + q] / n, s[1 + q : 1 + q + p * q].reshape(p, q).T / n, s[1 + q + p * q :].reshape(q, q) / n

        def minimise(t, w):
            for _ in range(max_iter):
                n, g, d, om = at(t)
                step = -np.linalg.lstsq(d.T @ w @ d, d.T @ w @ g, rcond=None)[0]
                value, size = g @ w @ g, 1.0
                while size > 1e-4:
                    m = at(t + size * step)[1]
                    if m @ w @ m <= value:
                        break
                    size /= 2
                t = t + size * step
                if np.max(np.abs(size * step)) < tol * max(1.0, np.max(np.abs(t))):
                    break
            return t

        n, g, d, om = at(theta)
        w = np.eye(len(g))
        theta = minimise(theta, w)
        for _ in range({"ONE_STEP": 0, "TWO_STEP": 1}.get(method, 10)):
            w = np.linalg.pinv(at(theta)[3])
            new = minimise(theta, w)
            small = np.max(np.abs(new - theta)) < tol
            theta = new
            if small:
                break
        n, g, d, om = at(theta)
        if cluster:
            q = len(g)
            sums = sum_rows_by(rows, ["_g"], lambda c: moments(c, theta), q)
            om = sum_rows(sums.select("v"), lambda c: c["v"].T @ c["v"]).reshape(q, q) / n
    finally:
        rows.unpersist()
    bread = np.linalg.pinv(d.T @ w @ d)
    cov = bread @ d.T @ w @ om @ w @ d @ bread / n
    j = float(n * g @ w @ g)
    return Fit([f"theta{i}" for i in range(p)], theta, cov, n - p, {"n": n, "j": j, "df_resid": n - p}, bread, use_t=False)


def gmm_iv_nonlinear(df: DataFrame, y: str, columns: list[str], func: Callable, instruments: list[str], start: np.ndarray, **more) -> Fit:
    """Moments z (y - f(x, theta)) with a constant among the instruments."""

    def moments(c, t):
        r = c[y] - np.asarray(func(c, t), float)
        return np.stack([r] + [r * c[z] for z in instruments], 1)

    return gmm(df, list(dict.fromkeys([y, *columns, *instruments])), moments, start, **more)


def nlls(df: DataFrame, y: str, columns: list[str], func: Callable, start: np.ndarray, names: list[str] | None = None, weights: str | None = None, bounds: tuple[np.ndarray, np.ndarray] | None = None, loss: str = "linear", cov_type: str = "NONROBUST", penalty: tuple[float, float] | None = None, max_iter: int = 200, tol: float = 1e-9) -> Fit:
    """Nonlinear least squares of ``func(columns, theta) -> rows`` by damped Gauss-Newton: one pass for J'WJ, J'Wr and the cost of several dampings.

    ``loss`` linear, soft_l1 or huber; ``bounds`` are kept by clipping; ``penalty`` (alpha, l1_ratio) solves each
    quadratic step by coordinate descent. Covariances NONROBUST, HC1; none for parameters at a bound.
    """
    p, theta = len(start), np.asarray(start, float)
    names = names or [f"theta{i}" for i in range(p)]
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    rows = df.select(F.col(y).cast("double").alias("_y"), w.alias("_w"), *[F.col(c).cast("double").alias(c) for c in columns]).na.drop().where("_w > 0").persist(StorageLevel.MEMORY_AND_DISK)
    low, high = bounds or (np.full(p, -np.inf), np.full(p, np.inf))

    def rho(r):
        if loss == "soft_l1":
            return 2 * (np.sqrt(1 + r * r) - 1), 1 / np.sqrt(1 + r * r)
        if loss == "huber":
            a = np.abs(r)
            return np.where(a <= 1, r * r, 2 * a - 1), np.where(a <= 1, 1, 1 / np.maximum(a, 1e-300))
        return r * r, np.ones_like(r)

    def jacobian(c, t):
        f = np.asarray(func(c, t), float)
        j = np.empty((len(f), p))
        for i in range(p):
            h = 1e-6 * max(1.0, abs(t[i]))
            e = np.zeros(p)
            e[i] = h
            j[:, i] = (np.asarray(func(c, t + e)) - np.asarray(func(c, t - e))) / (2 * h)
        return f, j

    def sums(c, t):
        f, j = jacobian(c, t)
        r = c["_y"] - f
        cost, irls = rho(r)
        wt = c["_w"] * irls
        s = j * (c["_w"] * irls * r)[:, None]
        return np.concatenate([[len(r), (c["_w"] * cost).sum()], (j.T @ (j * wt[:, None])).ravel(), s.sum(0), (s.T @ s).ravel()])

    try:
        damp = 1e-3
        for iteration in range(max_iter):
            s = sum_rows(rows, lambda c, t=theta: sums(c, t))
            n, cost, jj, jr = s[0], s[1], s[2 : 2 + p * p].reshape(p, p), s[2 + p * p : 2 + p * p + p]
            extra = lambda t: 0.0
            if penalty:
                a1, a2 = penalty[0] * penalty[1], penalty[0] * (1 - penalty[1])
                extra = lambda t: 2 * n * (a1 * np.abs(t).sum() + 0.5 * a2 * (t * t).sum())
            tries = damp * 10.0 ** np.array([-2, -1, 0, 1, 2, 4])
            options = []
            for d in tries:
                m = jj + d * np.diag(np.maximum(np.diag(jj), 1e-12))
                if penalty:
                    from gramlake.operators.penalized import coordinate_descent

                    new = coordinate_descent(m / n, (m @ theta + jr) / n, np.full(p, a1), np.full(p, a2), start=theta)
                else:
                    new = theta + np.linalg.lstsq(m, jr, rcond=None)[0]
                options.append(np.clip(new, low, high))

            def costs(c, options=options):
                with np.errstate(all="ignore"):
                    return np.array([np.nan_to_num((c["_w"] * rho(c["_y"] - np.asarray(func(c, t), float))[0]).sum(), nan=1e300, posinf=1e300) for t in options])

            v = sum_rows(rows, costs) + np.array([extra(t) for t in options])
            best = int(v.argmin())
            if v[best] >= cost + extra(theta):
                if tries[-1] > 1e12:
                    break
                damp = tries[-1] * 10
                if v[best] - cost - extra(theta) < 1e-14 * max(1.0, cost):
                    break
                continue
            moved = np.max(np.abs(options[best] - theta) / np.maximum(1.0, np.abs(theta)))
            theta, damp = options[best], max(tries[best], 1e-12)
            if moved < tol:
                break
        s = sum_rows(rows, lambda c: sums(c, theta))
    finally:
        rows.unpersist()
    n, cost, jj, meat = s[0], s[1], s[2 : 2 + p * p].reshape(p, p), s[2 + p * p + p :].reshape(p, p)
    inv = np.linalg.pinv(jj)
    cov = inv * cost / (n - p) if cov_type == "NONROBUST" else inv @ meat @ inv * n / (n - p)
    if bounds and ((theta <= low) | (theta >= high)).any():
        cov = np.full((p, p), np.nan)
    return Fit(names, theta, cov, n - p, {"n": n, "cost": float(cost), "iterations": iteration + 1, "converged": iteration + 1 < max_iter, "df_resid": n - p}, inv)


def pls(df: DataFrame, y: list[str], x: list[str], components: int) -> dict:
    """Partial least squares on centred columns from X'X and X'Y alone: weights, loadings and coefficients. One pass.

    One response needs no inner iterations; several take the dominant direction of X'Y by power steps.
    """
    from gramlake.operators.terms import num

    plan = Design(y, [num(c) for c in x]).fit(df)
    moved, g = centred_gram(plan.rows(df), plan)
    n, k, q = g.n, len(x), len(y)
    mx, my = g.xx[0, 1:] / n, g.xy[0] / n
    xx = g.xx[1:, 1:] - n * np.outer(mx, mx)
    xy = g.xy[1:] - n * np.outer(mx, my)
    yy = g.yy - n * np.outer(my, my)
    mx, my = mx + moved.plan.shift["x"][1:], my + moved.y
    w_all, p_all, q_all, s = [], [], [], xy.copy()
    r_all = []
    for _ in range(min(components, k)):
        if q == 1:
            w = s[:, 0] / np.linalg.norm(s[:, 0])
        else:
            c = s[:, int(np.argmax((s * s).sum(0)))]
            for _ in range(500):
                new = s @ (s.T @ c)
                new /= np.linalg.norm(new)
                if np.max(np.abs(new - c)) < 1e-14:
                    break
                c = new
            w = new
        r = w.copy()
        for p_, r_ in zip(p_all, r_all, strict=True):
            r -= (p_ @ w) * r_
        tt = r @ xx @ r
        p = xx @ r / tt
        qq = xy.T @ r / tt
        w_all.append(w)
        p_all.append(p)
        r_all.append(r)
        q_all.append(qq)
        s = s - np.outer(p, qq) * tt
    r, ql = np.array(r_all).T, np.array(q_all)
    coef = r @ ql
    intercept = my - mx @ coef
    fitted = np.diag(coef.T @ xx @ coef)
    return {"coef": coef, "intercept": intercept, "weights": np.array(w_all).T, "rotations": r, "loadings": np.array(p_all).T, "mean_x": mx, "r2": 1 - (np.diag(yy) - 2 * np.diag(coef.T @ xy) + fitted) / np.diag(yy)}


def pls_scores(df: DataFrame, model: dict, x: list[str]) -> DataFrame:
    """Scores of every row as columns t0, t1, ..."""
    r = model["rotations"]
    out = {}
    for j in range(r.shape[1]):
        total = F.lit(0.0)
        for c, m, v in zip(x, model["mean_x"], r[:, j], strict=True):
            total = total + (F.col(c) - F.lit(float(m))) * F.lit(float(v))
        out[f"t{j}"] = total
    return df.withColumns(out)
