"""Time series, many at a time: autocorrelation, autoregression, decomposition and forecasts by key.

Work is keyed by ``by`` and ordered by explicit columns. Autocovariances and regressions on lags are
windows and aggregates; methods that are sequential by nature run in applyInPandas, one series in memory.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramlake.operators.linear import fit_many


def autocovariance(df: DataFrame, value: str, by: list[str], order: list[str], nlags: int, adjusted: bool = False) -> DataFrame:
    """by, n, acov: array of lags 0..nlags of the demeaned series, over n or over n - lag if adjusted. One shuffle on ``by``."""
    w = Window.partitionBy(*by).orderBy(*order)
    c = df.where(F.col(value).isNotNull()).withColumn("_c", F.col(value).cast("double") - F.avg(F.col(value).cast("double")).over(Window.partitionBy(*by)))
    lagged = c.withColumns({f"_l{k}": F.lag("_c", k).over(w) for k in range(1, nlags + 1)})
    n = F.count("*")
    parts = [F.coalesce(F.sum(F.col("_c") * (F.col(f"_l{k}") if k else F.col("_c"))), F.lit(0.0)) / (n - k if adjusted else n) for k in range(nlags + 1)]
    return lagged.groupBy(*by).agg(n.alias("n"), F.array(*parts).alias("acov"))


def acf(df: DataFrame, value: str, by: list[str], order: list[str], nlags: int, adjusted: bool = False) -> DataFrame:
    """by, n, acf, std_err (Bartlett). A constant series has 1, 0, 0, ..."""
    a = autocovariance(df, value, by, order, nlags, adjusted)
    first = F.element_at("acov", 1)
    r = F.when(first > 0, F.transform("acov", lambda x: x / first)).otherwise(F.transform(F.sequence(F.lit(0), F.lit(nlags)), lambda i: (i == 0).cast("double")))
    out = a.select(*by, "n", r.alias("acf"))
    se = F.transform(F.sequence(F.lit(1), F.lit(nlags)), lambda k: F.sqrt((1 + 2 * F.aggregate(F.slice("acf", F.lit(2), k - 1), F.lit(0.0), lambda s, x: s + x * x)) / F.col("n")))
    return out.withColumn("std_err", se)


def _levinson(r: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, float]:
    """AR coefficients, partial autocorrelations and innovation variance from autocovariances."""
    phi, partial, v = np.zeros(0), [], r[0]
    for k in range(1, p + 1):
        kappa = (r[k] - phi @ r[k - 1 : 0 : -1][: len(phi)]) / v if v > 0 else 0.0
        phi = np.append(phi - kappa * phi[::-1], kappa)
        partial.append(kappa)
        v *= 1 - kappa * kappa
    return phi, np.array(partial), v


def pacf(df: DataFrame, value: str, by: list[str], order: list[str], nlags: int) -> DataFrame:
    """by, pacf: Durbin-Levinson on the autocovariances."""

    @F.pandas_udf("array<double>")
    def partial(a: pd.Series) -> pd.Series:
        return pd.Series([_levinson(np.asarray(x, float), nlags)[1].tolist() for x in a])

    return autocovariance(df, value, by, order, nlags).select(*by, partial("acov").alias("pacf"))


def ar_yule_walker(df: DataFrame, value: str, by: list[str], order: list[str], p: int) -> DataFrame:
    """by, n, ar, sigma2."""

    @F.pandas_udf("array<double>")
    def solve(a: pd.Series) -> pd.Series:
        out = []
        for x in a:
            phi, _, v = _levinson(np.asarray(x, float), p)
            out.append([*phi.tolist(), float(v)])
        return pd.Series(out)

    s = autocovariance(df, value, by, order, p).withColumn("_s", solve("acov"))
    return s.select(*by, "n", F.slice("_s", 1, p).alias("ar"), F.element_at("_s", p + 1).alias("sigma2"))


def ar_css(df: DataFrame, value: str, by: list[str], order: list[str], p: int) -> DataFrame:
    """by, n, r2, coef, std_err: regression on p lags with an intercept; rows without all lags are left out."""
    from gramlake.operators.windows import lags

    lagged = lags(df.where(F.col(value).isNotNull()), value, list(range(1, p + 1)), by, order)
    return fit_many(lagged, by, value, [f"{value}_l{k}" for k in range(1, p + 1)])


#: Powers of the time index (from 1) of each trend.
TRENDS = {"n": (), "c": (0,), "t": (1,), "ct": (0, 1), "ctt": (0, 1, 2)}


def autoreg(df: DataFrame, value: str, by: list[str], order: list[str], lag_list: list[int], trend: str = "c", periods: tuple[int, ...] = (), exog: tuple[str, ...] = ()) -> DataFrame:
    """Regression on lags with a trend (n, c, t, ct or ctt), seasonal dummies and other columns; by key.

    Coefficients are in the order constant (if the trend has one), lags, other columns, powers of time, seasons. A period
    that a larger one is a multiple of is left out; dummies leave out the first phase, but the first period keeps
    it where there is no constant.
    """
    from gramlake.operators.windows import lags, time_index

    if trend not in TRENDS:
        raise ValueError(f"trend must be one of {', '.join(TRENDS)}")
    d = time_index(lags(df.where(F.col(value).isNotNull()), value, lag_list, by, order), by, order, "_t")
    x = [f"{value}_l{k}" for k in lag_list] + list(exog)
    constant = 0 in TRENDS[trend]
    for power in TRENDS[trend]:
        if power:
            d = d.withColumn(f"trend{power}", F.pow(F.col("_t") + 1.0, power))
            x.append(f"trend{power}")
    kept = [s for s in sorted(set(periods)) if s > 1 and not any(q != s and q % s == 0 for q in periods)]
    for i, s in enumerate(kept):
        for k in range(0 if i == 0 and not constant else 1, s):
            d = d.withColumn(f"s{s}_{k}", (F.col("_t") % s == k).cast("double"))
            x.append(f"s{s}_{k}")
    return fit_many(d, by, value, x, intercept=constant)


def ardl(df: DataFrame, value: str, by: list[str], order: list[str], lag_list: list[int], regressors: dict[str, int], causal: bool = False) -> DataFrame:
    """Lags of the outcome and lags 0..order of each regressor (from 1 if causal), by key."""
    from gramlake.operators.windows import lags

    extra, d = [], df
    for c, o in regressors.items():
        steps = list(range(1 if causal else 0, o + 1))
        d = lags(d, c, [s for s in steps if s], by, order)
        extra += [c if s == 0 else f"{c}_l{s}" for s in steps]
    return autoreg(d, value, by, order, lag_list, exog=tuple(extra))


def arma(df: DataFrame, value: str, by: list[str], order: list[str], p: int, q: int, long_ar: int | None = None, seasonal_ar: tuple[int, ...] = (), seasonal_ma: tuple[int, ...] = ()) -> DataFrame:
    """Hannan-Rissanen: a long autoregression gives innovations, then one regression on lags of both; by key.

    Seasonal lags are added to lags 1..p of the series and 1..q of the innovations.
    """
    ar, ma = [*range(1, p + 1), *seasonal_ar], [*range(1, q + 1), *seasonal_ma]
    from gramlake.operators.windows import lags

    m = max(long_ar or p + q + 4, *seasonal_ar, 1)
    base = df.where(F.col(value).isNotNull()).select(*by, *order, F.col(value).cast("double").alias("_v"))
    lagged = lags(base, "_v", list(range(1, m + 1)), by, order)
    first = fit_many(lagged, by, "_v", [f"_v_l{k}" for k in range(1, m + 1)]).select(*by, F.col("coef").alias("_c"))
    joined = lagged.join(first, by)
    fitted = F.col("_c")[0]
    for k in range(1, m + 1):
        fitted = fitted + F.col("_c")[k] * F.col(f"_v_l{k}")
    inn = joined.withColumn("_e", F.col("_v") - fitted)
    inn = lags(inn, "_e", ma, by, order) if ma else inn
    return fit_many(inn, by, "_v", [f"_v_l{k}" for k in ar] + [f"_e_l{k}" for k in ma])


def _per_series(df: DataFrame, value: str, by: list[str], order: list[str], f, schema: str) -> DataFrame:
    kinds = ", ".join(f"`{b}` {df.schema[b].dataType.simpleString()}" for b in by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out = f(pdf)
        for i, b in enumerate(by):
            out.insert(i, b, pdf[b].iloc[0])
        return out

    return df.select(*dict.fromkeys([*by, *order, value])).where(F.col(value).isNotNull()).groupBy(*by).applyInPandas(run, f"{kinds}, {schema}")


def burg(x: np.ndarray, p: int) -> tuple[np.ndarray, float]:
    """AR coefficients and innovation variance by Burg's recursion on the demeaned series."""
    x = np.asarray(x, float) - np.mean(x)
    n, f, b, a = len(x), x.copy(), x.copy(), np.zeros(0)
    for k in range(1, p + 1):
        u, v = f[k:], b[k - 1 : n - 1]
        den = u @ u + v @ v
        kappa = 2 * (u @ v) / den if den > 0 else 0.0
        a = np.append(a - kappa * a[::-1], kappa)
        nf, nb = f.copy(), b.copy()
        nf[k:], nb[k:] = u - kappa * v, v - kappa * u
        f, b = nf, nb
    return a, float(f[p:] @ f[p:] / max(n - p, 1))


def ar_burg(df: DataFrame, value: str, by: list[str], order: list[str], p: int) -> DataFrame:
    """by, n, ar, sigma2; one series in memory at a time. Series of p + 1 values or fewer have nulls."""

    def f(pdf):
        x = pdf[value].to_numpy(float)
        if len(x) <= p + 1:
            return pd.DataFrame({"n": [len(x)], "ar": [None], "sigma2": [None]})
        a, s = burg(x, p)
        return pd.DataFrame({"n": [len(x)], "ar": [a.tolist()], "sigma2": [s]})

    return _per_series(df, value, by, order, f, "n long, ar array<double>, sigma2 double")


def ar_to_pacf(phi: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of AR coefficients (Levinson backwards)."""
    a, out = np.asarray(phi, float).copy(), []
    while len(a):
        k = a[-1]
        out.append(k)
        a = (a[:-1] + k * a[:-1][::-1]) / (1 - k * k) if len(a) > 1 else a[:0]
    return np.array(out[::-1])


def pacf_to_ar(kappa: np.ndarray) -> np.ndarray:
    a = np.zeros(0)
    for k in kappa:
        a = np.append(a - k * a[::-1], k)
    return a


def ar_mle(df: DataFrame, value: str, by: list[str], order: list[str], p: int) -> DataFrame:
    """Exact Gaussian likelihood over stationary AR(p) by derivative-free steps on the partial autocorrelations; by key."""

    def nll(kappa, x):
        phi = pacf_to_ar(kappa)
        v0 = np.prod(1 / (1 - kappa**2))
        n, total, logs = len(x), 0.0, 0.0
        a, v = np.zeros(0), v0
        for t in range(min(p, n)):
            e = x[t] - a @ x[:t][::-1][: len(a)]
            total += e * e / v
            logs += math.log(v)
            a = pacf_to_ar(kappa[: t + 1])
            v *= 1 - kappa[t] ** 2
        if n > p:
            e = x[p:] - sum(phi[i] * x[p - 1 - i : n - 1 - i] for i in range(p))
            total += e @ e
        return n * math.log(max(total / n, 1e-300)) + logs, total / n

    def f(pdf):
        x = pdf[value].to_numpy(float)
        if len(x) <= p + 1 or np.ptp(x) == 0:
            return pd.DataFrame({"n": [len(x)], "ar": [None], "sigma2": [None]})
        x = x - x.mean()
        kappa = np.clip(ar_to_pacf(burg(x, p)[0]), -0.99, 0.99)
        best, step = nll(kappa, x)[0], 0.1
        while step > 1e-6:
            improved = False
            for i in range(p):
                for d in (step, -step):
                    trial = kappa.copy()
                    trial[i] = np.clip(trial[i] + d, -0.999, 0.999)
                    value_ = nll(trial, x)[0]
                    if value_ < best - 1e-12:
                        kappa, best, improved = trial, value_, True
            if not improved:
                step /= 2
        return pd.DataFrame({"n": [len(x)], "ar": [pacf_to_ar(kappa).tolist()], "sigma2": [nll(kappa, x)[1]]})

    return _per_series(df, value, by, order, f, "n long, ar array<double>, sigma2 double")


def forecast(df: DataFrame, value: str, by: list[str], order: list[str], p: int, steps: int, d: int = 0) -> DataFrame:
    """by, step, mean, variance of an AR(p) (Burg) on the d-times differenced series, integrated back; variance by psi weights."""

    def f(pdf):
        x = pdf[value].to_numpy(float)
        if len(x) <= p + d + 1:
            return pd.DataFrame({"step": pd.Series([], dtype=int), "mean": pd.Series([], dtype=float), "variance": pd.Series([], dtype=float)})
        levels, y = [], x
        for _ in range(d):
            levels.append(y[-1])
            y = np.diff(y)
        mu = y.mean()
        a, s2 = burg(y, p)
        h = list(y - mu)
        for _ in range(steps):
            h.append(float(a @ np.array(h[::-1][:p])) if p else 0.0)
        mean = np.array(h[len(y) :]) + mu
        psi = np.zeros(steps)
        psi[0] = 1
        for j in range(1, steps):
            psi[j] = sum(a[i] * psi[j - 1 - i] for i in range(min(p, j)))
        for last in reversed(levels):
            mean, psi = last + np.cumsum(mean), np.cumsum(psi)
        return pd.DataFrame({"step": np.arange(1, steps + 1), "mean": mean, "variance": s2 * np.cumsum(psi * psi)})

    return _per_series(df, value, by, order, f, "step long, mean double, variance double")


def arma_forecast(df: DataFrame, value: str, by: list[str], order: list[str], p: int, q: int, future: DataFrame, exog: tuple[str, ...] = (), d: int = 0, long_ar: int | None = None) -> DataFrame:
    """``by``, ``order``, step, mean and variance for every row of ``future``, which has these columns and ``exog``.

    The fit is that of ``arma`` (innovations of a long autoregression, then one regression on lags of both) on the d-times differenced series,
    with regressors of each row; with q = 0 it is an autoregression with regressors, whose lags the tables may hold as
    columns. What a series leaves to its forecasts is p values, q innovations and d levels. These run over its future rows as the
    state of one fold, which also sums psi weights for the variance; a series' future rows are one list. Series that are too short to
    fit have null means; series without future rows aren't there.
    """
    from gramlake.operators.windows import _window, lags

    every = list(range(1, max(p, q, 1) + 1))
    base = df.where(F.col(value).isNotNull()).select(*by, *order, *exog, F.col(value).cast("double").alias("_d0"))
    w = _window(by, order)
    for i in range(d):
        base = base.withColumn(f"_d{i + 1}", F.col(f"_d{i}") - F.lag(f"_d{i}").over(w))
    rows = base.where(F.col(f"_d{d}").isNotNull()).withColumn("_v", F.col(f"_d{d}"))
    if q:
        m = max(long_ar or p + q + 4, 1)
        lagged = lags(rows, "_v", list(range(1, max(m, p) + 1)), by, order)
        first = fit_many(lagged, by, "_v", [f"_v_l{k}" for k in range(1, m + 1)]).select(*by, F.col("coef").alias("_c"))
        joined, fitted = lagged.join(first, by), F.col("_c")[0]
        for k in range(1, m + 1):
            fitted = fitted + F.col("_c")[k] * F.col(f"_v_l{k}")
        rows = lags(joined.withColumn("_e", F.col("_v") - fitted), "_e", list(range(1, q + 1)), by, order)
    else:
        rows = lags(rows.withColumn("_e", F.lit(0.0)), "_v", list(range(1, p + 1)), by, order)
    x = [f"_v_l{k}" for k in range(1, p + 1)] + [f"_e_l{k}" for k in range(1, q + 1)] + list(exog)
    fit = fit_many(rows, by, "_v", x).select(*by, F.col("n").alias("_n"), F.col("coef").alias("_b"))
    hat = F.col("_b")[0]
    for i, c in enumerate(x):
        hat = hat + F.col("_b")[i + 1] * F.col(c)
    last = _window(by, [F.col(c).desc() for c in order])
    ranked = rows.withColumn("_r", F.row_number().over(last)).join(fit, by)
    kept = F.when(F.col("_r") <= len(every), F.struct("_r", "_v", "_e"))
    state = ranked.groupBy(*by, "_n", "_b").agg(F.sort_array(F.collect_list(kept)).alias("_s"), (F.sum(F.pow(F.col("_v") - hat, 2)) / (F.col("_n") - len(x) - 1)).alias("_s2"), *[F.max(F.when(F.col("_r") == 1, F.col(f"_d{i}"))).alias(f"_l{i}") for i in range(d)])
    horizon = future.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(exog)]))).alias("_h"))
    numbers = lambda items: F.array(*items) if items else F.array().cast("array<double>")
    part = lambda name, n: numbers([F.col("_s")[k][name] for k in range(n)])
    kind = "array<struct<mean:double,variance:double>>"
    begin = F.struct(part("_v", p).alias("y"), part("_e", q).alias("e"), numbers([F.col(f"_l{i}") for i in range(d)]).alias("levels"), numbers([F.lit(0.0)] * p).alias("psi"), numbers([F.lit(0.0)] * d).alias("sums"), F.lit(0).alias("j"), F.lit(0.0).alias("total"), F.array().cast(kind).alias("out"))

    def step(a, row):
        mean = F.col("_b")[0]
        for k in range(p):
            mean = mean + F.col("_b")[k + 1] * a["y"][k]
        for k in range(q):
            mean = mean + F.col("_b")[p + k + 1] * a["e"][k]
        for i in range(len(exog)):
            mean = mean + F.col("_b")[p + q + i + 1] * row[f"x{i}"]
        psi = F.lit(0.0)
        for k in range(q):
            psi = F.when(a["j"] == k + 1, F.col("_b")[p + k + 1]).otherwise(psi)
        for k in range(p):
            psi = psi + F.col("_b")[k + 1] * a["psi"][k]
        psi = F.when(a["j"] == 0, 1.0).otherwise(psi)
        level, levels, weight, sums = mean, [], psi, []
        for i in reversed(range(d)):
            level, weight = a["levels"][i] + level, a["sums"][i] + weight
            levels.insert(0, level)
            sums.insert(0, weight)
        total = a["total"] + weight * weight
        shift = lambda old, new, n: F.slice(F.concat(F.array(new), old), 1, n) if n else old
        done = F.concat(a["out"], F.array(F.struct(level.alias("mean"), (F.col("_s2") * total).alias("variance"))))
        return F.struct(shift(a["y"], mean, p).alias("y"), shift(a["e"], F.lit(0.0), q).alias("e"), numbers(levels).alias("levels"), shift(a["psi"], psi, p).alias("psi"), numbers(sums).alias("sums"), (a["j"] + 1).alias("j"), total.alias("total"), done.alias("out"))

    folded = horizon.join(state, by, "left").withColumn("_f", F.aggregate("_h", begin, step, lambda a: a["out"]))
    one = folded.select(*by, F.posexplode(F.arrays_zip(F.col("_h").alias("h"), F.col("_f").alias("f"))).alias("_i", "_z"))
    return one.select(*by, *[F.col(f"_z.h.{c}").alias(c) for c in order], (F.col("_i") + 1).cast("long").alias("step"), "_z.f.mean", "_z.f.variance")


def loess(y: np.ndarray, window: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Local lines with tricube weights on the nearest ``window`` positions."""
    n = len(y)
    q = min(window, n)
    out = np.empty(n)
    t = np.arange(n, dtype=float)
    for i in range(n):
        a = min(max(i - q // 2, 0), n - q)
        s = slice(a, a + q)
        h = max(i - a, a + q - i) * 1.005  # to the window's first position and the one after its last
        w = (1 - (np.abs(t[s] - i) / h) ** 3) ** 3
        w = (w if weights is None else w * weights[s]) + 1e-6
        u = t[s] - i
        m0, m1, m2 = w.sum(), w @ u, w @ (u * u)
        det = m0 * m2 - m1 * m1
        out[i] = (m2 * (w @ y[s]) - m1 * (w @ (u * y[s]))) / det if det > 1e-12 * m0 * m2 else w @ y[s] / m0
    return out


def _seasonal_median(x: np.ndarray, period: int, window: float) -> np.ndarray:
    """Median of same-phase values within ``window`` cycles on either side; of all of them if the window covers them."""
    out = np.empty(len(x))
    for k in range(period):
        own = x[k::period]
        out[k::period] = np.median(own) if window >= len(own) and len(own) else [np.median(own[max(i - int(window), 0) : i + int(window) + 1]) for i in range(len(own))]
    return out


def stl(df: DataFrame, value: str, by: list[str], order: list[str], periods: list[int], swindow: float = math.inf, twindow: int | None = None, robust: bool = True, rounds: int = 3) -> DataFrame:
    """by, order, value, trend, seasonal_<p>, resid: a LOWESS trend and same-phase medians, fitted in turn; one series in memory.

    Each of ``rounds`` inner rounds smooths the series less its seasons, then takes the seasons of each period from
    what is left. With ``robust``, all of it is done once more with bisquare weights of the residuals on the trend.
    The trend's window is one and a half of the longest period if not given, made odd, and at least 3.
    """
    names = [f"seasonal_{p}" for p in periods]
    kinds = ", ".join(f"`{o}` {df.schema[o].dataType.simpleString()}" for o in order)

    def f(pdf):
        y = pdf[value].to_numpy(float)
        n = len(y)
        seasonal = {p: np.zeros(n) for p in periods}
        trend, w = np.zeros(n), None
        width = twindow or int(1.5 * max(periods)) | 1
        for outer in range(1 + robust):
            for _ in range(rounds):
                trend = loess(y - sum(seasonal.values()), min(n, max(3, width)), w)
                for p in periods:
                    seasonal[p] = _seasonal_median(y - trend - sum(v for q, v in seasonal.items() if q != p), p, swindow)
            if robust and not outer:
                r = np.abs(y - trend - sum(seasonal.values()))
                m = 6 * np.median(r)
                w = np.clip(1 - (r / m) ** 2, 0, 1) ** 2 if m > 6e-6 else np.ones(n)
        out = pdf[list(order)].reset_index(drop=True)
        out["value"], out["trend"] = y, trend
        for p, name in zip(periods, names, strict=True):
            out[name] = seasonal[p]
        out["resid"] = y - trend - sum(seasonal.values())
        return out

    return _per_series(df, value, by, order, f, ", ".join([kinds, "value double, trend double", *[f"{n} double" for n in names], "resid double"]))


def glsar(df: DataFrame, y: str, x: list[str], by: list[str], order: list[str], p: int = 1, iterations: int = 10, tol: float = 1e-8, keep_first: bool = True) -> dict:
    """Regression with AR(p) errors: alternate the fit on whitened rows and the AR of the residuals.

    With ``keep_first`` (Prais-Winsten) the first p rows of a series are scaled by the inverse Cholesky factor of their
    stationary covariance; without (Cochrane-Orcutt) they go. Lags are windowed once and kept; each iteration is a
    projection and one aggregate.
    """
    from gramlake.operators.linear import ols
    from gramlake.operators.terms import Design, num
    from gramlake.operators.windows import lags, time_index

    columns = [y, *x, "_one"]
    d = df.select(*by, *order, *[F.col(c).cast("double").alias(c) for c in (y, *x)]).na.drop().withColumn("_one", F.lit(1.0))
    for c in columns:
        d = lags(d, c, list(range(1, p + 1)), by, order)
    d = time_index(d, by, order, "_t").persist()
    rho, fit = np.zeros(p), None
    at = lambda c, k: F.col(c) if k == 0 else F.col(f"{c}_l{k}")
    try:
        for _ in range(iterations):
            inverse = np.linalg.inv(np.linalg.cholesky(_stationary(rho)))

            def white(c, rho=rho, inverse=inverse):
                out = F.when(F.col("_t") >= p, sum([at(c, k) * F.lit(-float(rho[k - 1])) for k in range(1, p + 1)], F.col(c)))
                for i in range(p):
                    out = out.when(F.col("_t") == i, sum([at(c, i - j) * F.lit(float(inverse[i, j])) for j in range(i + 1)], F.lit(0.0)))
                return out.alias(c)

            rows = d if keep_first else d.where(F.col("_t") >= p)
            fit = ols(rows.select(*[white(c) for c in columns]), Design([y], [num("_one"), *[num(c) for c in x]], intercept=False))

            def resid(k, b=fit.params):
                e = at(y, k)
                for c, v in zip(["_one", *x], b, strict=True):
                    e = e - at(c, k) * F.lit(float(v))
                return e

            es = d.where(F.col("_t") >= p).select(*[resid(k).alias(f"e{k}") for k in range(p + 1)])
            sums = es.agg(*[F.sum(F.col(f"e{i}") * F.col(f"e{j}")).alias(f"s{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]).first()
            m = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] for j in range(1, p + 1)] for i in range(1, p + 1)])
            new = np.linalg.solve(m, np.array([sums[f"s0_{j}"] for j in range(1, p + 1)]))
            change, rho = np.max(np.abs(new - rho)), new
            if change < tol:
                break
    finally:
        d.unpersist()
    return {"fit": fit, "rho": rho}


def _stationary(rho: np.ndarray) -> np.ndarray:
    """Covariance of p consecutive values of a stationary AR(p) with unit innovations."""
    p = len(rho)
    f = np.zeros((p, p))
    f[0] = rho
    f[1:, :-1] = np.eye(p - 1)
    q = np.zeros((p, p))
    q[0, 0] = 1.0
    v = np.linalg.solve(np.eye(p * p) - np.kron(f, f), q.ravel()).reshape(p, p)
    return (v + v.T) / 2
