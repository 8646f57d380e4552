"""Linear models from sums over rows: OLS, WLS, fixed effects, instruments, ridge, FGLS, many models, Shapley."""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.functions.special import chi2_sf, f_sf, norm_ppf, t_ppf, t_sf
from gramlake.operators import sparse
from gramlake.operators.rows import numpy_columns, sum_rows, sum_rows_by
from gramlake.operators.terms import Design, Plan, of


#: Rows that tell where columns lie.
LOCATION_ROWS = 256


@dataclass
class Gram:
    """Sums over rows of (z, x, y)(z, x, y)' with weights, and counts."""

    n: float
    sw: float
    slw: float
    m: np.ndarray  # weighted cross products of [X Y Z]
    k: int
    q: int

    @property
    def xx(self):
        return self.m[: self.k, : self.k]

    @property
    def xy(self):
        return self.m[: self.k, self.k : self.k + self.q]

    @property
    def yy(self):
        return self.m[self.k : self.k + self.q, self.k : self.k + self.q]

    @property
    def zz(self):
        return self.m[self.k + self.q :, self.k + self.q :]

    @property
    def zx(self):
        return self.m[self.k + self.q :, : self.k]

    @property
    def zy(self):
        return self.m[self.k + self.q :, self.k : self.k + self.q]


def gram(rows: DataFrame, plan: Plan, shift: np.ndarray | None = None) -> Gram:
    """One pass over the prepared rows, whose columns [X Y Z] are less ``shift`` if given. An empty table gives zeros.

    From sparse.WIDE dummies on, these stay level indices.
    """
    with_z = bool(plan.design.instruments)
    k, q = len(plan.names), len(plan.design.y)
    lay = sparse.layout(plan)
    if lay.dummies >= sparse.WIDE:
        return Gram(*(lambda s, m: (*s, m))(*sparse.products(rows, plan, lay, shift)), k, q)
    width = k + q + (len(plan.z_names) if with_z else 0)
    upper = np.triu_indices(width)

    def kernel(c):
        m = _whole(plan, c) if shift is None else _whole(plan, c) - shift
        return np.concatenate([[len(m), c["w"].sum(), np.log(c["w"]).sum()], (m.T @ (m * c["w"][:, None]))[upper]])

    s = sum_rows(rows, kernel)
    m = np.zeros((width, width))
    if len(s):
        m[upper] = s[3:]
        m = np.triu(m) + np.triu(m, 1).T
    return Gram(*(s[:3] if len(s) else np.zeros(3)), m, k, q)


def _whole(plan: Plan, c: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([plan.matrix(c), plan.outcomes(c)] + ([plan.matrix(c, "z")] if plan.design.instruments else []), 1)


def location(rows: DataFrame, plan: Plan) -> np.ndarray:
    """Where the columns [X Y Z] lie: their means over the first LOCATION_ROWS rows, 0 for the intercept and for dummies.

    Any constants near the means do: sums of products of what is less them don't cancel.
    """
    width = len(plan.names) + len(plan.design.y) + len(plan.z_names)
    some = rows.limit(LOCATION_ROWS).toArrow().combine_chunks()
    if not some.num_rows:
        return np.zeros(width)
    mean = _whole(plan, numpy_columns(some.to_batches()[0])).mean(axis=0)
    return np.where(_movable(plan), mean, 0.0)


def _movable(plan: Plan) -> np.ndarray:
    return np.concatenate([plan.numeric(), np.ones(len(plan.design.y), bool)] + ([plan.numeric("z")] if plan.design.instruments else []))


#: Deviations that a column's mean may lie from its constant before the sums are taken again about the mean.
FAR = 100.0


@dataclass
class Centred:
    """A design whose numeric columns are less constants near their means, and the way back.

    With an intercept that changes no slope and no fit, only the intercept's meaning; without one nothing is shifted. Fits work
    on ``plan``, whose sums of products don't cancel however far from 0 the columns lie, and are turned back at their end.
    """

    plan: Plan
    y: np.ndarray
    back: np.ndarray

    @staticmethod
    def at(plan: Plan, shift: np.ndarray) -> "Centred":
        k, q = len(plan.names), len(plan.design.y)
        if not plan.design.intercept:
            shift = np.zeros_like(shift)
        back = np.eye(k)  # from coefficients of shifted columns to those of the columns
        if plan.design.intercept:
            back[0, 1:] = -shift[1:k]
        return Centred(plan.shifted(shift[:k], shift[k + q :] if plan.design.instruments else None), shift[k : k + q], back)

    def fit(self, inner: "Fit", plan: Plan) -> "Fit":
        """The fit of the columns as they are; what it was inside stays as ``inner``."""
        out = replace(inner, params=self.back @ inner.params, cov=self.back @ inner.cov @ self.back.T, bread=None if inner.bread is None else self.back @ inner.bread @ self.back.T, plan=plan)
        out.inner = inner
        return out


def centred(rows: DataFrame, plan: Plan) -> Centred:
    """The design about its columns' means: one built-in aggregate over the (cached) rows of an iterative fit."""
    width = len(plan.names) + len(plan.design.y) + len(plan.z_names)
    names = []
    for part in ("x", "z") if plan.design.instruments else ("x",):
        names += [F.lit(0.0)] if plan.design.intercept else []
        for i, (t, found, drop) in enumerate(plan._parts(part)):
            names += [F.avg(f"{part}{i}_{j}") for j in range(len(t.names))] if found is None else [F.lit(0.0)] * (len(t.names) * (len(found) - drop))
        if part == "x":
            names += [F.avg(f"y{j}") for j in range(len(plan.design.y))]
    used = [i for i, m in enumerate(_movable(plan)) if m]
    shift = np.zeros(width)
    if plan.design.intercept and used:
        shift[used] = [v or 0.0 for v in rows.agg(*[names[i].alias(f"m{i}") for i in used]).first()]
    return Centred.at(plan, shift)


def centred_gram(rows: DataFrame, plan: Plan) -> tuple[Centred, Gram]:
    """Sums over rows of columns less constants near their means: one pass, and another where the first rows lie elsewhere."""
    k, q = len(plan.names), len(plan.design.y)
    if not plan.design.intercept:
        return Centred.at(plan, np.zeros(k + q + len(plan.z_names))), gram(rows, plan)
    shift = location(rows, plan)
    for _ in range(3):
        c = Centred.at(plan, shift)
        g = gram(rows, c.plan, np.concatenate([np.zeros(k), c.y, np.zeros(len(plan.z_names))]))
        if not g.sw:
            break
        mean = g.m[0] / g.sw
        deviation = np.sqrt(np.maximum(np.diag(g.m) / g.sw - mean * mean, 0))
        far = _movable(plan) & (np.abs(mean) > FAR * deviation) & (np.abs(mean) > 1e-9 * np.abs(shift))
        if not far.any():
            break
        shift = shift + np.where(_movable(plan), mean, 0.0)
    return c, g


def solve_centred(rows: DataFrame, plan: Plan) -> tuple[Centred, list["Fit"]]:
    """The way back, and for each outcome the fit of the shifted columns, with coefficients, inverse and statistics."""
    c, g = centred_gram(rows, plan)
    out = []
    for j in range(len(plan.design.y)):
        beta, bread = solve_scaled(g.xx, g.xy[:, j])
        stats = statistics(g, beta, plan.names, j)
        beta[:1] += c.y[j]
        out.append(Fit(plan.names, beta, bread * stats["sigma2"], stats["df_resid"], stats, bread, c.plan))
    return c, out


def solve_scaled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solution and inverse of a symmetric system, columns scaled first; a dependent column gets 0, the later one of a set."""
    d = np.sqrt(np.clip(np.diag(a), 0, None))
    d[d == 0] = 1.0
    inverse = _sweep(a / np.outer(d, d)) / np.outer(d, d)
    return inverse @ b, inverse


#: Columns up to which systems are solved without BLAS, whose threads cost small systems more than they bring.
SMALL = 512


def _sweep(s: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """Inverse of a scaled symmetric matrix; 0 for columns whose part that earlier ones don't explain is ``least`` or less."""
    if len(s) > SMALL:
        keep = independent(s, least)
        out = np.zeros_like(s)
        out[np.ix_(keep, keep)] = np.linalg.inv(s[np.ix_(keep, keep)])
        return out
    out, keep = s.copy(), np.zeros(len(s), bool)
    for j in range(len(s)):
        pivot = out[j, j]
        if pivot > least:
            row, column = out[j] / pivot, out[:, j].copy()
            out -= column[:, None] * row
            out[j], out[:, j], out[j, j] = row, -column / pivot, 1 / pivot
            keep[j] = True
    return np.where(keep[:, None] & keep, out, 0.0)


def independent(s: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """The columns that ``_sweep`` keeps: a Cholesky factor that skips the others."""
    try:
        if (np.diag(np.linalg.cholesky(s)) ** 2 > least).all():
            return np.arange(len(s))
    except np.linalg.LinAlgError:
        pass
    rest, keep = s.copy(), []
    for j in range(len(s)):
        if rest[j, j] > least:
            keep.append(j)
            column = rest[j:, j] / math.sqrt(rest[j, j])
            rest[j:, j:] -= column[:, None] * column
    return np.array(keep, int)


@dataclass
class Fit:
    """A fitted model: coefficients, their covariance, statistics, and what is needed to go on."""

    names: list[str]
    params: np.ndarray
    cov: np.ndarray
    df_resid: float
    stats: dict = field(default_factory=dict)
    bread: np.ndarray | None = None
    plan: Plan | None = None
    use_t: bool = True

    def __post_init__(self):
        """Says which columns had nothing of their own and got 0."""
        if self.bread is not None and len(self.bread) == len(self.names):
            self.stats["dropped"] = [n for n, v in zip(self.names, np.diag(self.bread), strict=True) if v == 0]

    @property
    def bse(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    def p_values(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.abs(self.params / self.bse)
        return 2 * t_sf(t, self.df_resid) if self.use_t else np.array([math.erfc(x / math.sqrt(2)) for x in t])

    def table(self, spark, level: float = 0.95, digits: int | None = None) -> DataFrame:
        """term, coef, std_err, t, p, ci_lo, ci_hi."""
        se, p = self.bse, self.p_values()
        z = t_ppf(0.5 + level / 2, self.df_resid) if self.use_t else norm_ppf(0.5 + level / 2)
        cut = (lambda x: float(x)) if digits is None else (lambda x: round(float(x), digits) + 0.0)
        rows = [(n, cut(b), cut(s), cut(b / s if s > 0 else math.nan), cut(pv), cut(b - z * s), cut(b + z * s)) for n, b, s, pv in zip(self.names, self.params, se, p, strict=True)]
        return spark.createDataFrame(rows, "term string, coef double, std_err double, t double, p double, ci_lo double, ci_hi double")

    def save(self, path: str, spark) -> None:
        """One JSON row that any cluster can read back."""
        state = {"names": self.names, "params": self.params.tolist(), "cov": self.cov.tolist(), "df_resid": self.df_resid, "stats": self.stats, "use_t": self.use_t}
        spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(path: str, spark, plan: Plan | None = None) -> "Fit":
        s = json.loads(spark.read.text(path).first().value)
        return Fit(s["names"], np.array(s["params"]), np.array(s["cov"]), s["df_resid"], s["stats"], plan=plan, use_t=s["use_t"])


def statistics(g: Gram, beta: np.ndarray, names: list[str], y: int = 0, extra_df: int = 0) -> dict:
    """R2, adjusted R2, F, log-likelihood, AIC and BIC from the sums. Uncentred without a constant."""
    xx, xy, yy = g.xx, g.xy[:, y], g.yy[y, y]
    ssr = float(yy - 2 * beta @ xy + beta @ xx @ beta)
    ssr = max(ssr, 0.0)
    const = "Intercept" in names
    k = int(np.count_nonzero(np.diag(xx) > 0)) + extra_df
    i = names.index("Intercept") if const else None
    sst = float(yy - xy[i] ** 2 / xx[i, i]) if const and xx[i, i] > 0 else float(yy)
    n, dfm = g.n, k - (1 if const or extra_df else 0)
    llf = -n / 2 * (math.log(2 * math.pi / n) + 1 + math.log(ssr)) + 0.5 * g.slw if ssr > 0 and n else math.nan
    r2 = 1 - ssr / sst if sst > 0 else math.nan
    f = ((sst - ssr) / dfm) / (ssr / (n - k)) if dfm > 0 and n > k and ssr > 0 else math.nan
    return {"n": n, "df_model": dfm, "df_resid": n - k, "ssr": ssr, "sst": sst, "r2": r2, "r2_adj": 1 - (1 - r2) * (n - (1 if const or extra_df else 0)) / (n - k) if n > k else math.nan, "f": f, "f_p": float(f_sf(f, dfm, n - k)) if f == f else math.nan, "llf": llf, "aic": -2 * llf + 2 * (dfm + 1), "bic": -2 * llf + math.log(max(n, 1)) * (dfm + 1), "sigma2": ssr / (n - k) if n > k else math.nan}


def ols(df: DataFrame, design: Design, cov_type: str = "OLS_SMALL", cluster: list[str] | None = None, y: int = 0) -> Fit:
    """(Weighted) least squares: one pass for the sums, and one more for a robust covariance.

    cov_type: NONROBUST, OLS_SMALL, HC0..HC3, CLUSTER (with ``cluster``: one or several columns, combined by
    inclusion and exclusion). Rows that aren't valid are left out; dependent columns get 0.
    """
    from gramlake.operators import covariance

    plan = design.fit(df)
    rows = plan.rows(df, keep=list(dict.fromkeys(cluster or [])))
    c, fits = solve_centred(rows, plan)
    fit = fits[y]
    fit.cov = covariance.of(rows, fit, cov_type, cluster, y)
    if cov_type == "CLUSTER":
        fit.df_resid = fit.stats["n_clusters"] - 1
    return c.fit(fit, plan)


def multi_outcome(df: DataFrame, design: Design) -> list[Fit]:
    """One pass, one right side for each outcome."""
    plan = design.fit(df)
    c, fits = solve_centred(plan.rows(df), plan)
    return [c.fit(f, plan) for f in fits]


def ridge(df: DataFrame, design: Design, alpha: float, free: tuple[str, ...] = ("Intercept",), normalize: bool = False) -> Fit:
    """Least squares with alpha on the diagonal, but for the free terms; ``normalize`` scales it by n times the column's variance."""
    plan = design.fit(df)
    c, g = centred_gram(plan.rows(df), plan) if "Intercept" in free else (Centred.at(plan, np.zeros(len(plan.names) + len(plan.design.y) + len(plan.z_names))), gram(plan.rows(df), plan))
    i = plan.names.index("Intercept") if "Intercept" in plan.names else None
    var = np.diag(g.xx) / g.sw - ((g.xx[:, i] / g.sw) ** 2 if i is not None else 0)
    load = np.array([0.0 if n in free else alpha * (g.n * v if normalize else 1.0) for n, v in zip(plan.names, var, strict=True)])
    beta, inverse = solve_scaled(g.xx + np.diag(load), g.xy[:, 0])
    stats = statistics(g, beta, plan.names)
    beta[:1] += c.y[0]
    return c.fit(Fit(plan.names, beta, inverse @ g.xx @ inverse * stats["sigma2"], stats["df_resid"], stats, inverse, c.plan), plan)


def lm_fast(df: DataFrame, design: Design) -> np.ndarray:
    """Coefficients alone."""
    plan = design.fit(df)
    c, fits = solve_centred(plan.rows(df), plan)
    return c.back @ fits[0].params


def absorb_gram(df: DataFrame, design: Design, by: list[str]) -> tuple[Plan, Gram, int]:
    """Sums of the within-group deviations in one shuffle: each group's sums S give sum(xx') - S S' / n.

    Rows never join their group's means; what moves is one sum a group, added up before the shuffle, so a
    group of any size is safe. Several columns are one interacted effect. Returns the number of groups.
    """
    plan = Design(design.y, design.x, design.instruments, design.weights, False).fit(df)
    keyed = [F.col(c).cast("string").alias(f"g{i}") for i, c in enumerate(by)]
    known = df
    for c in by:
        known = known.where(F.col(c).isNotNull())
    rows = plan.rows(known, keep=keyed)
    shift = location(rows, plan)  # deviations don't depend on it, their rounding does
    total = gram(rows, plan, shift)
    with_z = bool(design.instruments)
    width = total.m.shape[0]
    plain = [plan.plain(), [F.col(f"y{i}") for i in range(len(design.y))], plan.plain("z") if with_z else []]
    if all(p is not None for p in plain) and width <= 40:
        columns = [c for p in plain for c in p]
        grouped = rows.groupBy(*[f"g{i}" for i in range(len(by))]).agg(F.sum("w").alias("_w"), *[F.sum((c - F.lit(float(shift[i]))) * F.col("w")).alias(f"_s{i}") for i, c in enumerate(columns)])
        sums = grouped.select(F.array("_w", *[f"_s{i}" for i in range(width)]).alias("v"))
    else:
        sums = sum_rows_by(rows, [f"g{i}" for i in range(len(by))], lambda c: np.concatenate([c["w"][:, None], (_whole(plan, c) - shift) * c["w"][:, None]], 1), 1 + width)

    def between(c):
        v = c["v"]
        s = v[:, 1:]
        return np.concatenate([[len(v)], (s.T @ (s / v[:, :1])).ravel()])

    b = sum_rows(sums.select("v"), between)
    groups, m = (int(b[0]), total.m - b[1:].reshape(width, width)) if len(b) else (0, total.m)
    return plan, Gram(total.n, total.sw, total.slw, m, total.k, total.q), groups


def absorb_ols(df: DataFrame, design: Design, by: list[str], cluster: list[str] | None = None) -> Fit:
    """Least squares with one absorbed effect (the interaction of ``by``): the slopes that its dummies would give."""
    from gramlake.operators import covariance

    plan, g, groups = absorb_gram(df, design, by)
    beta, bread = solve_scaled(g.xx, g.xy[:, 0])
    stats = statistics(g, beta, plan.names, extra_df=groups)
    fit = Fit(plan.names, beta, bread * stats["sigma2"], stats["df_resid"], stats | {"groups": groups}, bread, plan)
    if cluster:
        within = demean(df, design, by, cluster, groups)
        x, y = [f"x{i}" for i in range(len(plan.names))], "y0"
        fit.cov = covariance.clustered_columns(within, fit.bread, fit.params, x, y, cluster, g.n, len(beta) + groups, fit.stats)
        fit.df_resid = fit.stats["n_clusters"] - 1
    return fit


def iv_absorb(df: DataFrame, design: Design, by: list[str]) -> Fit:
    """Two-stage least squares with one absorbed effect: from the within-group sums of instruments, regressors and outcome alone."""
    plan, g, groups = absorb_gram(df, design, by)
    pi, _ = solve_scaled(g.zz, g.zx)
    a = pi.T @ g.zx
    beta, bread = solve_scaled((a + a.T) / 2, pi.T @ g.zy[:, 0])
    stats = statistics(g, beta, plan.names, extra_df=groups)
    return Fit(plan.names, beta, bread * stats["sigma2"], stats["df_resid"], stats | {"groups": groups}, bread, plan)


#: Groups whose means a join keeps as hash tables in its tasks, where it would sort the rows.
HASHED_GROUPS = 5_000_000


def demean(df: DataFrame, design: Design, by: list[str], keep: list[str] = (), groups: int | None = None) -> DataFrame:
    """Rows with y and X less their (weighted) group means: y0, x0.., w, ``by``, ``keep``. A shuffle on ``by``.

    Means are aggregated before the shuffle and joined back; the skewed side of that join can be split. Of up to HASHED_GROUPS
    groups, if their number is known, the tasks hold means alone and sort no rows.
    """
    plan = Design(design.y, design.x, [], design.weights, False).fit(df)
    if any(found is not None for _, found, _ in plan._parts("x")):
        raise ValueError("absorb the categorical terms")
    columns = [of(c).cast("double").alias(f"x{i}") for i, c in enumerate(c for t, _, _ in plan._parts("x") for c in t.columns)]
    known = df.where(plan.design.valid(df))
    for c in by:
        known = known.where(F.col(c).isNotNull())
    weight = F.col(design.weights).cast("double") if design.weights else F.lit(1.0)
    extra = list(dict.fromkeys([*by, *keep]))
    rows = known.select(F.expr(design.y[0]).cast("double").alias("y0"), *columns, weight.alias("w"), *extra)
    names = ["y0", *[f"x{i}" for i in range(len(columns))]]
    means = rows.groupBy(*by).agg(*[(F.sum(F.col(n) * F.col("w")) / F.sum("w")).alias(f"m_{n}") for n in names])
    if groups is not None and groups <= HASHED_GROUPS:
        means = means.hint("shuffle_hash")
    joined = rows.join(means, by)
    return joined.select(*[(F.col(n) - F.col(f"m_{n}")).alias(n) for n in names], "w", *extra)


def absorbed_effects(df: DataFrame, design: Design, by: list[str], fit: Fit) -> DataFrame:
    """by, n, effect: the group's mean outcome less what the slopes explain of it. One aggregate."""
    columns = [c for t, _, _ in fit.plan._parts("x") for c in t.columns]
    known = df.where(fit.plan.design.valid(df))
    weight = F.col(design.weights).cast("double") if design.weights else F.lit(1.0)
    rest = F.expr(design.y[0]).cast("double")
    for c, b in zip(columns, fit.params, strict=True):
        rest = rest - of(c) * F.lit(float(b))
    return known.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(rest * weight) / F.sum(weight)).alias("effect"))


def iv_2sls(df: DataFrame, design: Design, cov_type: str = "OLS_SMALL") -> Fit:
    """Two-stage least squares from Z'Z, Z'X, Z'y and X'X alone; X-hat is never made for the coefficients."""
    plan = whole = design.fit(df)
    rows = plan.rows(df)
    moved, g = centred_gram(rows, plan)
    plan = moved.plan
    pi, _ = solve_scaled(g.zz, g.zx)
    a = pi.T @ g.zx
    beta, bread = solve_scaled((a + a.T) / 2, pi.T @ g.zy[:, 0])
    stats = statistics(g, beta, plan.names)
    beta[:1] += moved.y[0]
    k = len(beta)
    cov = bread * stats["ssr"] / (g.n - k if cov_type == "OLS_SMALL" else g.n)
    if cov_type.startswith("HC"):

        def meat(c):
            hat = plan.matrix(c, "z") @ pi
            s = hat * (c["w"] * (plan.outcomes(c)[:, 0] - plan.matrix(c) @ beta))[:, None]
            return s.T @ s

        m = sum_rows(rows, meat).reshape(k, k) * (g.n / (g.n - k) if cov_type == "HC1" else 1.0)
        cov = bread @ m @ bread
    first = {}
    for j, name in enumerate(plan.names):
        if name not in plan.z_names:
            tss = g.xx[j, j] - (g.zx[0, j] ** 2 / g.zz[0, 0] if design.intercept else 0)
            ssr = g.xx[j, j] - pi[:, j] @ g.zx[:, j]
            r2 = 1 - ssr / tss
            excluded = [i for i, z in enumerate(plan.z_names) if z not in plan.names]
            included = [i for i, z in enumerate(plan.z_names) if z in plan.names]
            p0, _ = solve_scaled(g.zz[np.ix_(included, included)], g.zx[included, j])
            ssr0 = g.xx[j, j] - p0 @ g.zx[included, j]
            first[name] = {"r2": r2, "f": ((ssr0 - ssr) / len(excluded)) / (ssr / (g.n - len(plan.z_names)))}
    return moved.fit(Fit(plan.names, beta, cov, g.n - k, stats | {"first_stage": first}, bread, plan), whole)


def fgls(df: DataFrame, design: Design, iterations: int = 1) -> Fit:
    """Feasible GLS: regress log squared residuals on X, weigh by exp(-fit / 2), and fit again. Two passes an iteration."""
    plan = whole = design.fit(df)
    rows = plan.rows(df)
    moved, g = centred_gram(rows, plan)
    plan = moved.plan
    beta, bread = solve_scaled(g.xx, g.xy[:, 0])
    k, gamma = len(beta), np.zeros(len(beta))
    stats = statistics(g, beta, plan.names)
    beta[:1] += moved.y[0]
    for _ in range(iterations):

        def logs(c, beta=beta):
            x = plan.matrix(c)
            e = plan.outcomes(c)[:, 0] - x @ beta
            return np.concatenate([(x.T @ (x * c["w"][:, None])).ravel(), x.T @ (np.log(np.maximum(e * e, 1e-300)) * c["w"])])

        s = sum_rows(rows, logs)
        gamma = gamma + solve_scaled(s[: k * k].reshape(k, k), s[k * k :])[0]

        def weighted(c, gamma=gamma):
            x, y = plan.matrix(c), plan.outcomes(c)[:, :1] - moved.y[:1]
            w = c["w"] * np.exp(-0.5 * (x @ gamma))
            m = np.concatenate([x, y], 1)
            return np.concatenate([[len(x), w.sum(), np.log(w).sum()], (m.T @ (m * w[:, None])).ravel()])

        s = sum_rows(rows, weighted)
        g = Gram(s[0], s[1], s[2], s[3:].reshape(k + 1, k + 1), k, 1)
        beta, bread = solve_scaled(g.xx, g.xy[:, 0])
        stats = statistics(g, beta, plan.names)
        beta[:1] += moved.y[0]
    return moved.fit(Fit(plan.names, beta, bread * stats["sigma2"], stats["df_resid"], stats | {"gamma": (moved.back @ gamma).tolist()}, bread, plan), whole)


def sure(df: DataFrame, designs: dict[str, Design], cluster: str) -> Fit:
    """Several equations on the same rows with a joint clustered covariance: scores of all equations add up within a cluster."""
    plans = {n: d.fit(df) for n, d in designs.items()}
    betas, breads, names, sizes = [], [], [], []
    valid = df.where(F.col(cluster).isNotNull())
    back = np.zeros((0, 0))
    for n, d in designs.items():
        c, g = centred_gram(plans[n].rows(valid), plans[n])
        plans[n] = c.plan
        b, inv = solve_scaled(g.xx, g.xy[:, 0])
        b[:1] += c.y[0]
        betas.append(b)
        back = np.block([[back, np.zeros((len(back), len(b)))], [np.zeros((len(b), len(back))), c.back]])
        breads.append(inv)
        names += [f"{n}.{t}" for t in plans[n].names]
        sizes.append(g.n)
    width = len(names)
    bread = np.zeros((width, width))
    at, parts = 0, None
    for (n, d), b, inv in zip(designs.items(), betas, breads, strict=True):
        k = len(b)
        bread[at : at + k, at : at + k] = inv
        rows = plans[n].rows(valid, keep=[F.col(cluster).cast("string").alias("g")])

        def score(c, plan=plans[n], b=b, at=at, k=k):
            x = plan.matrix(c)
            out = np.zeros((len(x), width))
            out[:, at : at + k] = x * (c["w"] * (plan.outcomes(c)[:, 0] - x @ b))[:, None]
            return out

        s = sum_rows_by(rows, ["g"], score, width)
        parts = s if parts is None else parts.unionByName(s)
        at += k
    by = parts.groupBy("g").agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)]).select(F.array(*[f"s{i}" for i in range(width)]).alias("v"))
    s = sum_rows(by, lambda c: np.concatenate([[len(c["v"])], (c["v"].T @ c["v"]).ravel()]))
    clusters, meat = s[0], s[1:].reshape(width, width)
    n, k = min(sizes), max(len(b) for b in betas)
    meat *= (n - 1) / (n - k) * clusters / (clusters - 1)
    return Fit(names, back @ np.concatenate(betas), back @ bread @ meat @ bread @ back.T, clusters - 1, {"n": n, "n_clusters": clusters}, back @ bread @ back.T)


def fit_many(df: DataFrame, keys: list[str], y: str, x: list[str], weights: str | None = None, intercept: bool = True) -> DataFrame:
    """One least-squares fit for each key: keys, n, r2, and coef, std_err arrays in the order Intercept, x.

    Built-in aggregates by key (map-side combined, one shuffle): covariances, which don't cancel, where there is an
    intercept and no weights, and else sums of products. Batches of small systems are solved at once on the executors.
    Without an intercept r2 is uncentred. Groups with too few rows or dependent columns have null coefficients.
    """
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    rows = df.select(*keys, F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(c) for c in x], F.col(y).cast("double").alias("_y"), w.alias("_w"))
    ok = F.lit(True)
    for c in [*x, "_y", "_w"]:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    centred = intercept and weights is None
    columns = [*x, "_y"] if centred or not intercept else ["_one", *x, "_y"]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)] if centred else []
    product = (lambda a, b: F.covar_pop(a, b) * F.count("*")) if centred else (lambda a, b: F.sum(F.col(a) * F.col(b) * F.col("_w")))
    sums = rows.where(ok & (F.col("_w") > 0)).groupBy(*keys).agg(F.count("*").alias("n"), *[product(columns[i], columns[j]).alias(f"s{a}") for a, (i, j) in enumerate(pairs)], *means)
    k = len(columns) - 1
    schema = ", ".join([f"`{f}` {df.schema[f].dataType.simpleString()}" for f in keys] + ["n long, r2 double, coef array<double>, std_err array<double>"])

    def solve(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            c = numpy_columns(batch.select([f.name for f in batch.schema if f.name not in keys]))
            m = np.zeros((batch.num_rows, k + 1, k + 1))
            for a, (i, j) in enumerate(pairs):
                m[:, i, j] = m[:, j, i] = c[f"s{a}"]
            n = c["n"].astype(float)
            free = n - k - centred
            d = np.sqrt(np.maximum(m[:, range(k), range(k)], 1e-300))
            s = m[:, :k, :k] / (d[:, :, None] * d[:, None, :])
            good = (free > 0) & (np.abs(np.linalg.det(s)) > 1e-10)
            s[~good] = np.eye(k)
            inverse = np.linalg.inv(s) / (d[:, :, None] * d[:, None, :])
            beta = np.einsum("gij,gj->gi", inverse, m[:, :k, k])
            ssr = np.maximum(m[:, k, k] - np.einsum("gi,gi->g", beta, m[:, :k, k]), 0)
            sst = m[:, k, k] if centred or not intercept else m[:, k, k] - m[:, 0, k] ** 2 / np.maximum(m[:, 0, 0], 1e-300)
            if centred:  # the intercept and its variance from the means
                mean = np.stack([c[f"m{i}"] for i in range(k + 1)], 1)
                whole = np.zeros((len(n), k + 1, k + 1))
                whole[:, 1:, 1:] = inverse
                whole[:, 0, 1:] = whole[:, 1:, 0] = -np.einsum("gij,gj->gi", inverse, mean[:, :k])
                whole[:, 0, 0] = 1 / n - np.einsum("gi,gi->g", whole[:, 0, 1:], mean[:, :k])
                beta = np.concatenate([(mean[:, k] - np.einsum("gi,gi->g", beta, mean[:, :k]))[:, None], beta], 1)
                inverse = whole
            se = np.sqrt(np.maximum(np.einsum("gii->gi", inverse), 0) * (ssr / np.maximum(free, 1))[:, None])
            with np.errstate(divide="ignore", invalid="ignore"):
                r2 = np.where(good & (sst > 0), 1 - ssr / sst, np.nan)
            lists = [[v.tolist() if g else None for v, g in zip(part, good, strict=True)] for part in (beta, se)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], batch.column(len(keys)), pa.array(r2, from_pandas=True), *(pa.array(x, pa.list_(pa.float64())) for x in lists)], [*keys, "n", "r2", "coef", "std_err"])

    return sums.mapInArrow(solve, schema)


def level_ols(df: DataFrame, y: str, by: list[str], slopes: list[str] = (), x: list[str] = (), weights: str | None = None, also: list[str] = ()) -> tuple[Fit, DataFrame]:
    """Least squares with a dummy for each level of ``by``, with slopes of its own for ``slopes``, and common slopes for ``x``.

    For any number of levels: the normal equations are small blocks, one a level, bordered by the common slopes. Sums by
    level are built-in aggregates (map-side combined, one shuffle); blocks are eliminated where they lie; only sums as wide
    as ``x`` reach the driver. Returns the fit of the common slopes, and a table of ``by``, n, coef, std_err (arrays: the
    level's constant, then its slopes; one constant for every level and no common one). Rows with a null in any of these
    columns are left out; a column that is dependent within its level gets 0.

    ``also``: further categorical columns, of up to MOST_LEVELS levels in all, whose dummies (but each one's first) are common
    columns, ``C(column)[level]``. Their border is sparse: a level of ``by`` has sums for those levels that occur with it, one
    list a level; a task adds what eliminating its levels leaves to one square of the common columns.
    """
    if also:
        return _two_way(df, y, by, list(slopes), list(x), weights, list(also))
    columns = ["_one", *(f"_s{i}" for i in range(len(slopes))), *(f"_x{i}" for i in range(len(x))), "_y"]
    m, p = 1 + len(slopes), len(x)
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    values = [F.lit(1.0), *[F.col(c).cast("double") for c in (*slopes, *x, y)]]
    rows = df.select(*by, *[v.alias(c) for v, c in zip(values, columns, strict=True)], w.alias("_w"))
    ok = F.col("_w") > 0
    for c in by:
        ok = ok & F.col(c).isNotNull()
    for c in [*columns[1:], "_w"]:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = rows.where(ok)
    some = rows.select(*columns).limit(LOCATION_ROWS).toArrow()
    shift = np.array([np.mean(some[c].to_numpy()) if some.num_rows else 0.0 for c in columns])
    shift[0] = 0.0  # constants of levels take up any shift
    of_shifted = [F.col(c) - F.lit(float(v)) if v else F.col(c) for c, v in zip(columns, shift, strict=True)]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.sum(of_shifted[i] * of_shifted[j] * F.col("_w")) for i, j in pairs]).alias("v")).persist()
    index = np.zeros((len(columns), len(columns)), int)
    for a, (i, j) in enumerate(pairs):
        index[i, j] = index[j, i] = a

    def eliminate(v):
        """Each level's inverse block, its slopes on the common columns and on y, and what is left of the border."""
        whole = v[:, index]
        block, border = whole[:, :m, :m], whole[:, :m, m:]
        inverse = np.zeros_like(block)
        for i, b in enumerate(block):
            inverse[i] = solve_scaled(b, np.zeros(m))[1]
        onto = inverse @ border
        return inverse, onto, whole[:, m:, m:] - np.einsum("gij,gik->gjk", border, onto)

    try:

        def left(c):
            inverse, _, rest = eliminate(c["v"])
            return np.concatenate([[c["n"].sum(), (np.einsum("gii->gi", inverse) > 0).sum()], rest.sum(axis=0).ravel()])

        s = sum_rows(sums.select("n", "v"), left)
        n, used, rest = (s[0], s[1], s[2:].reshape(p + 1, p + 1)) if len(s) else (0.0, 0.0, np.zeros((p + 1, p + 1)))
        gamma, v = solve_scaled(rest[:p, :p], rest[:p, p])
        ssr = max(float(rest[p, p] - gamma @ rest[:p, p]), 0.0)
        free = n - used - np.count_nonzero(np.diag(v))
        sigma2 = ssr / free if free > 0 else math.nan
        fit = Fit(list(x), gamma, v * sigma2, free, {"n": n, "ssr": ssr, "df_resid": free, "sigma2": sigma2}, v)
        kinds = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)

        def level(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                inverse, onto, _ = eliminate(numpy_columns(batch.select(["v"]))["v"])
                coef = onto[:, :, p] - onto[:, :, :p] @ gamma
                # back to columns that aren't shifted: constant = y's shift - slopes times theirs
                back = np.eye(m)
                back[0, 1:] = -shift[1:m]
                coef = coef @ back.T
                coef[:, 0] += shift[-1] - shift[m : m + p] @ gamma
                turned = back @ onto[:, :, :p]
                turned[:, 0, :] += shift[m : m + p]
                var = np.einsum("gii->gi", back @ inverse @ back.T) + np.einsum("gij,jk,gik->gi", turned, v, turned)
                se = np.sqrt(np.maximum(var, 0) * sigma2)
                lists = [pa.array(part.tolist(), pa.list_(pa.float64())) for part in (coef, se)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(by) + 1], *lists], [*by, "n", "coef", "std_err"])

        from gramlake.operators.state import cut

        return fit, cut(sums.mapInArrow(level, f"{kinds}, n long, coef array<double>, std_err array<double>"))
    finally:
        sums.unpersist()


def _two_way(df: DataFrame, y: str, by: list[str], slopes: list[str], x: list[str], weights: str | None, also: list[str]) -> tuple[Fit, DataFrame]:
    """``level_ols`` with further categorical columns."""
    from gramlake.operators.rows import add_rows
    from gramlake.operators.state import cut
    from gramlake.operators.terms import MOST_LEVELS, finite

    spark, m, p = df.sparkSession, 1 + len(slopes), len(x)
    w = F.col(weights).cast("double") if weights else F.lit(1.0)
    columns = ["_one", *(f"_s{i}" for i in range(len(slopes))), *(f"_x{i}" for i in range(p)), "_y"]
    values = [F.lit(1.0), *[F.col(c).cast("double") for c in (*slopes, *x, y)]]
    rows = df.select(*by, *[v.alias(c) for v, c in zip(values, columns, strict=True)], w.alias("_w"), *[F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(also)])
    ok = F.col("_w") > 0
    for c in [*by, *[f"_c{i}" for i in range(len(also))]]:
        ok = ok & F.col(c).isNotNull()
    for c in [*columns[1:], "_w"]:
        ok = ok & finite(F.col(c))
    rows = rows.where(ok)
    names, at = list(x), 0
    for i, c in enumerate(also):
        found = sorted(r[0] for r in rows.select(f"_c{i}").distinct().limit(MOST_LEVELS + 1).collect())
        if at + len(found) > MOST_LEVELS:
            raise ValueError(f"more than {MOST_LEVELS} levels of {', '.join(also)}: let the widest be ``by``")
        table = spark.createDataFrame([(v, at + j - 1 if j else -1) for j, v in enumerate(found)], f"_v{i} string, _i{i} int")
        rows = rows.join(F.broadcast(table), F.col(f"_c{i}") == F.col(f"_v{i}"))
        names += [f"C({c})[{v}]" for v in found[1:]]
        at += max(len(found) - 1, 0)
    q, k = at, p + at
    some = rows.select(*columns).limit(LOCATION_ROWS).toArrow()
    shift = np.array([np.mean(some[c].to_numpy()) if some.num_rows else 0.0 for c in columns])
    shift[0] = 0.0
    moved = [F.col(c) - F.lit(float(v)) if v else F.col(c) for c, v in zip(columns, shift, strict=True)]
    narrow = rows.select(*by, *[c.alias(f"_m{i}") for i, c in enumerate(moved)], "_w", *[f"_i{i}" for i in range(len(also))]).persist()
    width = len(columns)
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    index = np.zeros((width, width), int)
    for a, (i, j) in enumerate(pairs):
        index[i, j] = index[j, i] = a
    try:
        # sums of the dummies' columns by level of `by`, and over all rows: with the numeric columns, and with one another
        dummy = F.explode(F.array(*[F.col(f"_i{i}") for i in range(len(also))])).alias("i")
        each = narrow.select(*by, dummy, "_w", *[f"_m{i}" for i in range(width)]).where("i >= 0")
        cross = each.groupBy(*by, "i").agg(F.array(*[F.sum(F.col(f"_m{j}") * F.col("_w")) for j in range(m)]).alias("v"))
        lists = cross.groupBy(*by).agg(F.collect_list(F.struct("i", "v")).alias("l"))  # at most one entry for each dummy
        sums = narrow.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(f"_m{i}") * F.col(f"_m{j}") * F.col("_w")) for i, j in pairs]).alias("v"))
        sums = sums.join(lists, by, "left").select(*by, "n", "v", F.coalesce(F.transform("l", lambda e: e["i"].cast("double")), F.array().cast("array<double>")).alias("i"), F.coalesce(F.flatten(F.transform("l", lambda e: e["v"])), F.array().cast("array<double>")).alias("c"))
        sums = cut(sums)
        total = np.zeros((k + 1, k + 1))
        own = [*range(p), k]  # x and y among the common columns
        for r in each.groupBy("i").agg(F.array(F.sum("_w"), *[F.sum(F.col(f"_m{m + j}") * F.col("_w")) for j in range(p + 1)]).alias("v")).collect():
            total[p + r.i, p + r.i] = r.v[0]
            total[p + r.i, own] = total[own, p + r.i] = r.v[1:]
        for a in range(len(also)):
            for b in range(a):
                for r in narrow.where(f"_i{a} >= 0 and _i{b} >= 0").groupBy(f"_i{a}", f"_i{b}").agg(F.sum("_w").alias("s")).toLocalIterator():
                    total[p + r[0], p + r[1]] = total[p + r[1], p + r[0]] = r.s

        def eliminated(c):
            """For each level its inverse block, the common columns that occur in it, and their border's image."""
            for v, i, s in zip(c["v"], c["i"], c["c"], strict=True):
                block = v[index]
                inverse = solve_scaled(block[:m, :m], np.zeros(m))[1]
                here = np.concatenate([np.arange(p), p + np.asarray(i, int), [k]]).astype(int)
                border = np.concatenate([block[:m, m : m + p], np.reshape(s, (-1, m)).T, block[:m, m + p :]], 1)
                yield block, inverse, here, border, inverse @ border

        def left(c, out):
            square = out[2:].reshape(k + 1, k + 1)
            for block, inverse, here, border, onto in eliminated(c):
                square[np.ix_(here, here)] -= border.T @ onto
                square[np.ix_(own, own)] += block[m:, m:]
                out[1] += np.count_nonzero(np.diag(inverse) > 0)
            out[0] += c["n"].sum()

        s = add_rows(sums.select("n", "v", "i", "c"), 2 + (k + 1) ** 2, left)
        n, used, rest = s[0], s[1], s[2:].reshape(k + 1, k + 1) + total
        gamma, v = solve_scaled(rest[:k, :k], rest[:k, k])
        ssr = max(float(rest[k, k] - gamma @ rest[:k, k]), 0.0)
        free = n - used - np.count_nonzero(np.diag(v))
        sigma2 = ssr / free if free > 0 else math.nan
        fit = Fit(names, gamma, v * sigma2, free, {"n": n, "ssr": ssr, "df_resid": free, "sigma2": sigma2}, v)
        shared = spark.sparkContext.broadcast((gamma, v))  # as wide as the common columns, which are bounded
        kinds = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)
        back = np.eye(m)
        back[0, 1:] = -shift[1:m]

        def level(batches):
            gamma, v = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                coefs, errors = [], []
                for _, inverse, here, _, onto in eliminated(numpy_columns(batch.select(["v", "i", "c"]))):
                    common = here[:-1]
                    coef = back @ (onto[:, -1] - onto[:, :-1] @ gamma[common])
                    coef[0] += shift[-1] - shift[m : m + p] @ gamma[:p]
                    turned = back @ onto[:, :-1]
                    turned[0, :p] += shift[m : m + p]
                    var = np.diag(back @ inverse @ back.T) + np.einsum("ij,jk,ik->i", turned, v[np.ix_(common, common)], turned)
                    coefs.append(coef.tolist())
                    errors.append(np.sqrt(np.maximum(var, 0) * sigma2).tolist())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(by) + 1], *(pa.array(a, pa.list_(pa.float64())) for a in (coefs, errors))], [*by, "n", "coef", "std_err"])

        return fit, cut(sums.mapInArrow(level, f"{kinds}, n long, coef array<double>, std_err array<double>"))
    finally:
        narrow.unpersist()


def shapley_r2(df: DataFrame, y: str, terms: list[str], samples: int | None = None, seed: int = 1) -> DataFrame:
    """term, value, share of R2 that each term earns: over all subsets, or over ``samples`` orderings. Always with intercept.

    One pass for the sums; the subsets are dealt over tasks, each solving its own from the broadcast block.
    """
    from gramlake.operators.terms import num

    design = Design([y], [num(t) for t in terms])
    plan = design.fit(df)
    _, g = centred_gram(plan.rows(df), plan)
    p, spark = len(terms), df.sparkSession
    m = g.m - np.outer(g.m[0], g.m[0]) / g.m[0, 0]
    s, sy, sst = m[1 : p + 1, 1 : p + 1], m[1 : p + 1, p + 1], m[p + 1, p + 1]

    def r2(subset: tuple[int, ...]) -> float:
        if not subset:
            return 0.0
        i = list(subset)
        return float(solve_scaled(s[np.ix_(i, i)], sy[i])[0] @ sy[i] / sst) if sst > 0 else 0.0

    def exact(batches):
        for batch in batches:
            out = np.zeros(p)
            for mask in batch.column(0).to_pylist():
                inside = [i for i in range(p) if mask >> i & 1]
                base = r2(tuple(inside))
                weight = math.factorial(len(inside)) * math.factorial(max(p - len(inside) - 1, 0)) / math.factorial(p)
                for i in range(p):
                    if not mask >> i & 1:
                        out[i] += weight * (r2(tuple(sorted([*inside, i]))) - base)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p)), pa.array(out)], ["i", "v"])

    def sampled(batches):
        for batch in batches:
            out = np.zeros(p)
            for draw in batch.column(0).to_pylist():
                order = np.random.default_rng([seed, draw]).permutation(p).tolist()
                base = 0.0
                for j, i in enumerate(order):
                    now = r2(tuple(sorted(order[: j + 1])))
                    out[i] += (now - base) / samples
                    base = now
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(p)), pa.array(out)], ["i", "v"])

    values = spark.range(samples or 1 << p).mapInArrow(sampled if samples else exact, "i long, v double").groupBy("i").agg(F.sum("v").alias("value"))
    named = spark.createDataFrame(list(enumerate(terms)), "i long, term string")
    total = r2(tuple(range(p)))
    return values.join(named, "i").select("term", "value", (F.col("value") / total).alias("pct"))


def ssr_at(g: Gram, betas: DataFrame) -> DataFrame:
    """Adds ssr to a table of parameter vectors (column ``beta``), from the sums alone."""
    xx, xy, yy = g.xx, g.xy[:, 0], g.yy[0, 0]

    @F.pandas_udf("double")
    def ssr(b):
        import pandas as pd

        m = np.stack([np.asarray(x, float) for x in b]) if len(b) else np.zeros((0, len(xy)))
        return pd.Series(yy - 2 * m @ xy + np.einsum("ij,jk,ik->i", m, xx, m))

    return betas.withColumn("ssr", ssr("beta"))


def wald(fit: Fit, r: np.ndarray, q: np.ndarray | None = None, use_f: bool = True) -> dict:
    """Test of R b = q."""
    r = np.atleast_2d(np.asarray(r, float))
    d = r @ fit.params - (0 if q is None else q)
    stat = float(d @ np.linalg.solve(r @ fit.cov @ r.T, d))
    k = len(r)
    return {"statistic": stat / k, "p": float(f_sf(stat / k, k, fit.df_resid))} if use_f else {"statistic": stat, "p": float(chi2_sf(stat, k))}


def delta_method(fit: Fit, func, step: float = 1e-6) -> dict:
    """Value and standard error of a function of the parameters, by central differences."""
    b = fit.params
    steps = np.diag(step * np.maximum(1.0, np.abs(b)))
    grad = np.array([(func(b + e) - func(b - e)) / (2 * e.sum()) for e in steps])
    value, se = float(func(b)), math.sqrt(float(grad @ fit.cov @ grad))
    return {"value": value, "std_err": se, "p": float(2 * t_sf(abs(value / se), fit.df_resid)) if se else math.nan}


def fieller(fit: Fit, top: int, bottom: int, level: float = 0.95) -> dict:
    """Interval of a ratio of two coefficients; not finite where the denominator may be zero."""
    a, b = fit.params[top], fit.params[bottom]
    t = t_ppf(0.5 + level / 2, fit.df_resid)
    vaa, vbb, vab = fit.cov[top, top], fit.cov[bottom, bottom], fit.cov[top, bottom]
    A, B, C = b * b - t * t * vbb, a * b - t * t * vab, a * a - t * t * vaa
    root = B * B - A * C
    if A <= 0 or root < 0:
        return {"ratio": a / b, "lo": -math.inf, "hi": math.inf}
    return {"ratio": a / b, "lo": (B - math.sqrt(root)) / A, "hi": (B + math.sqrt(root)) / A}


def lift(fit: Fit, treatment: str, means: dict[str, float]) -> dict:
    """Effect over the control mean at average covariates, with its delta-method error. ``means`` has the other terms' averages."""
    at = np.array([1.0 if n == "Intercept" else 0.0 if n == treatment else means[n] for n in fit.names])
    t = fit.names.index(treatment)
    return delta_method(fit, lambda b: b[t] / (at @ b))


def lift_ratio(fit: Fit, top: str, bottom: str, top_base: str, bottom_base: str) -> dict:
    """Ratio of two relative effects, each a coefficient over its base, across the equations of one joint fit."""
    i, j, k, m = (fit.names.index(n) for n in (top, bottom, top_base, bottom_base))
    return delta_method(fit, lambda b: (b[i] / b[k]) / (b[j] / b[m]))


def leverage(fit: Fit, df: DataFrame, name: str = "leverage") -> DataFrame:
    """w x'(X'WX)^-1 x of every row of a numeric design, as an expression."""
    inner = getattr(fit, "inner", fit)
    rows = [F.lit(1.0)] if fit.plan.design.intercept else []
    rows += [of(c) for t, found, _ in fit.plan._parts("x") for c in t.columns if found is None]
    rows = [c - F.lit(float(v)) for c, v in zip(rows, inner.plan.shift.get("x", np.zeros(len(rows))), strict=True)]
    total = F.lit(0.0)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            total = total + a * b * F.lit(float(inner.bread[i, j]))
    return df.withColumn(name, total * (F.col(fit.plan.design.weights) if fit.plan.design.weights else F.lit(1.0)))


def subsets(items):
    return itertools.chain.from_iterable(itertools.combinations(items, r) for r in range(1, len(items) + 1))
