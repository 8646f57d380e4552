"""Elastic net from sums over rows, its diagnostics, and cross-validation from one pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.operators.linear import Fit, Gram, centred, centred_gram, gram, ols, solve_scaled
from gramlake.operators.rows import sum_rows_by
from gramlake.operators.terms import Design


def coordinate_descent(a: np.ndarray, b: np.ndarray, l1: np.ndarray, l2: np.ndarray, target: np.ndarray | None = None, positive: bool = False, start: np.ndarray | None = None, max_iter: int = 20_000, tol: float = 1e-10) -> np.ndarray:
    """Minimum of x'Ax/2 - b'x + sum l1 |x - t| + l2 (x - t)^2 / 2, one coordinate at a time."""
    k = len(b)
    t = np.zeros(k) if target is None else np.asarray(target, float)
    x = (t.copy() if start is None else start.copy()).astype(float)
    grad = a @ x - b
    for _ in range(max_iter):
        most = 0.0
        for j in range(k):
            if a[j, j] <= 0:
                continue
            u = a[j, j] * (x[j] - t[j]) - grad[j]  # in terms of the distance to the target
            v = np.sign(u) * max(abs(u) - l1[j], 0.0) / (a[j, j] + l2[j])
            new = v + t[j]
            if positive:
                new = max(new, 0.0)
            d = new - x[j]
            if d:
                grad += a[:, j] * d
                x[j] = new
                most = max(most, abs(d) * np.sqrt(a[j, j]))
        if most < tol:
            break
    return x


def elastic_net(df: DataFrame, design: Design, alpha: float | dict[str, float], l1_ratio: float | dict[str, float] = 1.0, normalize: bool = False, refit: bool = False, free: tuple[str, ...] = ("Intercept",), positive: bool = False, targets: dict[str, float] | None = None) -> Fit:
    """SSR / (2n) + alpha l1_ratio |b - t| + alpha (1 - l1_ratio) (b - t)^2 / 2 without a penalty on ``free``. One pass; refit adds OLS with HC1 on the support.

    ``alpha`` and ``l1_ratio`` may name values by term (others: 0 and 1), ``targets`` what coefficients shrink to (others: 0).
    """
    plan = design.fit(df)
    c, g = centred_gram(plan.rows(df), plan) if "Intercept" in free else (None, gram(plan.rows(df), plan))
    i = plan.names.index("Intercept") if "Intercept" in plan.names else None
    sd = np.sqrt(np.maximum(np.diag(g.xx) / g.sw - ((g.xx[:, i] / g.sw) ** 2 if i is not None else 0), 0))
    scale = np.where([n in free for n in plan.names], 0.0, sd if normalize else 1.0)
    alphas = np.array([alpha.get(n, 0.0) if isinstance(alpha, dict) else alpha for n in plan.names])
    ratios = np.array([l1_ratio.get(n, 1.0) if isinstance(l1_ratio, dict) else l1_ratio for n in plan.names])
    target = np.array([(targets or {}).get(n, 0.0) for n in plan.names])
    if target[np.array([n in free for n in plan.names])].any():
        raise ValueError("a free term has no target")
    l1, l2 = alphas * ratios * scale, alphas * (1 - ratios) * scale * scale
    # in terms of the distance to the targets: the outcome is less what the targets explain
    moved = Gram(g.n, g.sw, g.slw, g.m.copy(), g.k, g.q)
    moved.xy[:, 0] = g.xy[:, 0] - g.xx @ target
    moved.yy[0, 0] = g.yy[0, 0] - 2 * target @ g.xy[:, 0] + target @ g.xx @ target
    a, b = g.xx / g.n, g.xy[:, 0] / g.n
    beta = coordinate_descent(a, b, l1, l2, target, positive, _start(a, b - a @ target, i) + target)
    stats = {"n": g.n, "objective": objective(moved, beta - target, l1, l2), "duality_gap": duality_gap(moved, beta - target, l1, l2), "nonzero": int(np.count_nonzero(beta)), "df_resid": g.n - np.count_nonzero(beta)}
    if c is not None:
        beta = c.back @ beta
        beta[:1] += c.y[0]
    fit = Fit(plan.names, beta, np.zeros((len(beta), len(beta))), stats["df_resid"], stats, None, plan)
    if refit:
        keep = [t for t, nm in zip(design.x, [n for n in plan.names if n != "Intercept"], strict=False) if beta[plan.names.index(nm)] != 0]
        fit.refit = ols(df, Design(design.y, keep, weights=design.weights, intercept=design.intercept), "HC1")
    return fit


def _start(a: np.ndarray, b: np.ndarray, i: int | None) -> np.ndarray:
    x = np.zeros(len(b))
    if i is not None and a[i, i] > 0:
        x[i] = b[i] / a[i, i]
    return x


def objective(g, beta: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> float:
    ssr = g.yy[0, 0] - 2 * beta @ g.xy[:, 0] + beta @ g.xx @ beta
    return float(ssr / (2 * g.n) + l1 @ np.abs(beta) + 0.5 * l2 @ (beta * beta))


def duality_gap(g, beta: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> float:
    """Distance of the objective from a feasible dual value: the ridge part joins the sums, free columns are projected out."""
    free = l1 == 0
    a, b, yy = g.xx / g.n + np.diag(l2), g.xy[:, 0] / g.n, g.yy[0, 0] / g.n
    if free.any():
        inv = solve_scaled(a[np.ix_(free, free)], b[free])[1]
        cross = a[np.ix_(~free, free)]
        a2, b2, yy = a[np.ix_(~free, ~free)] - cross @ inv @ cross.T, b[~free] - cross @ inv @ b[free], yy - b[free] @ inv @ b[free]
    else:
        a2, b2 = a, b
    x, w = beta[~free], l1[~free]
    grad = b2 - a2 @ x
    ssr = yy - 2 * b2 @ x + x @ a2 @ x
    shrink = min(1.0, float(np.min(np.where(np.abs(grad) > 0, w / np.maximum(np.abs(grad), 1e-300), np.inf)))) if len(w) else 1.0
    primal = 0.5 * ssr + w @ np.abs(x)
    residual_y = yy - b2 @ x
    dual = shrink * residual_y - 0.5 * shrink**2 * ssr
    return float(primal - dual)


def cross_validate(df: DataFrame, design: Design, alphas: list[float], folds: int, key: list[str], l1_ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """alpha, mse: mean out-of-fold squared error. One pass sums each hashed fold; every fold and alpha is solved from these."""
    plan = design.fit(df)
    rows = plan.rows(df, keep=[F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(folds)).alias("fold")])
    k = len(plan.names)
    moved = centred(rows, plan)

    def kernel(c):
        m = np.concatenate([moved.plan.matrix(c), plan.outcomes(c) - moved.y], 1)
        return np.concatenate([np.ones((len(m), 1)), ((m * c["w"][:, None])[:, :, None] * m[:, None, :]).reshape(len(m), -1)], 1)

    parts = {r.fold: np.array(r.v) for r in sum_rows_by(rows, ["fold"], kernel, 1 + (k + 1) ** 2).collect()}
    total = sum(parts.values())
    free = np.array([n == "Intercept" for n in plan.names])
    out = []
    for alpha in alphas:
        error = 0.0
        for v in parts.values():
            n, m = (total - v)[0], (total - v)[1:].reshape(k + 1, k + 1)
            a, b = m[:k, :k] / n, m[:k, k] / n
            l1, l2 = np.where(free, 0, alpha * l1_ratio), np.where(free, 0, alpha * (1 - l1_ratio))
            beta = coordinate_descent(a, b, l1, l2, start=_start(a, b, int(np.argmax(free)) if free.any() else None))
            h = v[1:].reshape(k + 1, k + 1)
            error += h[k, k] - 2 * beta @ h[:k, k] + beta @ h[:k, :k] @ beta
        out.append((float(alpha), float(error / total[0])))
    return df.sparkSession.createDataFrame(out, "alpha double, mse double")
