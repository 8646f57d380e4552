"""Covariances of least-squares fits: classical, heteroskedasticity-robust, clustered, and for serial correlation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramlake.operators import sparse
from gramlake.operators.rows import add_rows, sum_rows, sum_rows_by


def of(rows: DataFrame, fit, kind: str, cluster: list[str] | None = None, y: int = 0) -> np.ndarray:
    """Covariance of ``fit`` over its prepared rows; at most one pass, and a shuffle for each set of cluster columns."""
    s, k, bread, plan, beta = fit.stats, len(fit.params), fit.bread, fit.plan, fit.params
    if kind == "NONROBUST":
        return bread * s["ssr"] / max(s["n"], 1)
    if kind == "OLS_SMALL":
        return bread * s["sigma2"]
    if kind in ("HC0", "HC1", "HC2", "HC3"):

        lay = sparse.layout(plan, outcomes=False)
        if lay.dummies >= sparse.WIDE:

            def wide(c, total):
                e = c["w"] * (c[f"y{y}"] - sparse.dot(plan, lay, c, beta))
                if kind in ("HC2", "HC3"):
                    h = np.clip(1 - c["w"] * sparse.quadratic(plan, lay, c, bread), 1e-12, None)
                    e = e / (np.sqrt(h) if kind == "HC2" else h)
                sparse.add_products(plan, lay, c, e * e, total)

            if all((a, b) in lay.pairs for b in range(len(lay.terms)) for a in range(b)):
                m = sparse.unpack(lay, add_rows(rows, lay.length, wide))
                return bread @ m @ bread * (s["n"] / (s["n"] - k) if kind == "HC1" else 1.0)

        def meat(c):
            x = plan.matrix(c)
            e = c["w"] * (plan.outcomes(c)[:, y] - x @ beta)
            if kind in ("HC2", "HC3"):
                h = np.clip(1 - c["w"] * np.einsum("ij,jk,ik->i", x, bread, x), 1e-12, None)
                e = e / (np.sqrt(h) if kind == "HC2" else h)
            z = x * e[:, None]
            return z.T @ z

        got = sum_rows(rows, meat)
        m = got.reshape(k, k) if len(got) else np.zeros((k, k))
        return bread @ m @ bread * (s["n"] / (s["n"] - k) if kind == "HC1" else 1.0)
    if kind == "CLUSTER":
        from gramlake.operators.linear import subsets

        total, fewest = np.zeros((k, k)), math.inf
        for part in subsets(cluster):

            def score(c):
                x = plan.matrix(c)
                return x * (c["w"] * (plan.outcomes(c)[:, y] - x @ beta))[:, None]

            groups, m = _meat(rows, plan, beta, part, y, k, score)
            if groups < 2:
                raise ValueError("clustered errors need two clusters at least")
            total += (-1) ** (len(part) + 1) * m * (s["n"] - 1) / (s["n"] - k) * groups / (groups - 1)
            if len(part) == 1:
                fewest = min(fewest, groups)
        s["n_clusters"] = fewest
        return bread @ total @ bread
    raise ValueError(f"unknown covariance {kind}")


def _meat(rows: DataFrame, plan, beta: np.ndarray, part: tuple[str, ...], y: int, k: int, score) -> tuple[float, np.ndarray]:
    """Number of clusters and the sum of s s' over their summed scores. Numeric designs stay in built-in sums; dummies take the kernel."""
    columns = plan.plain()
    if columns is None or k > 12:
        keyed = rows.select("*", *[F.col(c).cast("string").alias(f"_g{i}") for i, c in enumerate(part)])
        sums = sum_rows_by(keyed, [f"_g{i}" for i in range(len(part))], score, k)
        got = sum_rows(sums.select("v"), lambda c: np.concatenate([[len(c["v"])], (c["v"].T @ c["v"]).ravel()]))
        return got[0], got[1:].reshape(k, k)
    e = F.col(f"y{y}")
    for c, b in zip(columns, beta, strict=True):
        e = e - c * F.lit(float(b))
    scores = rows.select(*part, *[(c * e * F.col("w")).alias(f"_s{i}") for i, c in enumerate(columns)])
    sums = scores.groupBy(*part).agg(*[F.sum(f"_s{i}").alias(f"_s{i}") for i in range(k)])
    r = sums.agg(F.count("*").alias("g"), *[F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return r.g, np.array([[r[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])


#: Rows of a task that adds up scores by cluster: a table of sums has a row for each of them where clusters are small.
SPREAD_ROWS = 250_000


def spread(scores: DataFrame, n: float) -> DataFrame:
    """Scores in tasks of about SPREAD_ROWS rows, however large the parts that a join left; a large cluster's rows go to all of them."""
    parts = math.ceil(n / SPREAD_ROWS)
    return scores.repartition(parts, *scores.columns) if parts > 1 else scores


def clustered_columns(within: DataFrame, bread: np.ndarray, beta: np.ndarray, x: list[str], y: str, cluster: list[str], n: float, k: int, stats: dict) -> np.ndarray:
    """Clustered covariance of demeaned rows, by inclusion and exclusion: scores sum up by cluster as plain columns."""
    from gramlake.operators.linear import subsets

    e = F.col(y)
    for name, b in zip(x, beta, strict=True):
        e = e - F.col(name) * F.lit(float(b))
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    total, fewest = np.zeros((len(x), len(x))), math.inf
    for part in subsets(cluster):
        scores = spread(within.select(*part, *[(F.col(name) * F.col("w") * e).alias(f"s{i}") for i, name in enumerate(x)]), n)
        sums = scores.groupBy(*part).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(x))])
        r = sums.agg(F.count("*").alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
        if r.g < 2:
            raise ValueError("clustered errors need two clusters at least")
        m = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(len(x))] for i in range(len(x))])
        total += (-1) ** (len(part) + 1) * m * (n - 1) / (n - k) * r.g / (r.g - 1)
        if len(part) == 1:
            fewest = min(fewest, r.g)
    stats["n_clusters"] = fewest
    return bread @ total @ bread


def default_lags(n: float) -> int:
    return int(math.floor(4 * (n / 100) ** (2 / 9)))


def hac_panel(df: DataFrame, fit, panel: list[str], order: list[str], x: list[str], y: str, lags: int | None = None, kernel: str = "bartlett", small: bool = False) -> np.ndarray:
    """Newey-West sums within each panel: lagged products of score columns by window, one shuffle on the panel.

    ``x`` are the numeric columns of the fit after its intercept. One series without panels is ``hac_series``.
    """
    lags = default_lags(fit.stats["n"]) if lags is None else lags
    rows = df.where(fit.plan.design.valid(df)).withColumn("_halo", F.lit(False))
    return _hac(fit, rows, panel, order, x, y, lags, kernel, small)


def _hac(fit, rows: DataFrame, panel: list[str], order: list[str], x: list[str], y: str, lags: int, kernel: str, small: bool) -> np.ndarray:
    n, beta, k = fit.stats["n"], fit.params, len(fit.params)
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    e = F.col(y).cast("double")
    for c, b in zip(columns, beta, strict=True):
        e = e - c * F.lit(float(b))
    scored = rows.select(*panel, *order, "_halo", *[(c * e).alias(f"s{i}") for i, c in enumerate(columns)])
    w = Window.partitionBy(*panel).orderBy(*order)
    sums = []
    lagged = scored
    for lag in range(1, lags + 1):
        lagged = lagged.withColumns({f"l{lag}_{j}": F.lag(f"s{j}", lag).over(w) for j in range(k)})
    for i in range(k):
        for j in range(k):
            total = F.col(f"s{i}") * F.col(f"s{j}")
            for lag in range(1, lags + 1):
                weight = 1 - lag / (lags + 1) if kernel == "bartlett" else 1.0
                total = total + F.lit(weight) * (F.coalesce(F.col(f"s{i}") * F.col(f"l{lag}_{j}"), F.lit(0.0)) + F.coalesce(F.col(f"l{lag}_{i}") * F.col(f"s{j}"), F.lit(0.0)))
            sums.append(F.sum(total).alias(f"m{i}_{j}"))
    r = lagged.where("not _halo").agg(*sums).first()
    m = np.array([[r[f"m{i}_{j}"] for j in range(k)] for i in range(k)])
    return fit.bread @ m @ fit.bread * (n / (n - k) if small else 1.0)


def hac_series(df: DataFrame, fit, order: list[str], x: list[str], y: str, lags: int | None = None, kernel: str = "bartlett", small: bool = False, block: int = 100_000) -> np.ndarray:
    """Newey-West sums over one global order: blocks of consecutive rows, each with the last rows of the block before it.

    The order is a range-partitioned global index, so no task sorts the whole series; a pair of rows is counted in the
    block of its later row.
    """
    from gramlake.operators.windows import global_index

    lags = default_lags(fit.stats["n"]) if lags is None else lags
    block = max(block, lags + 1)
    placed = global_index(df.where(fit.plan.design.valid(df)).select(*order, *x, y), order, "_t")
    own = (F.col("_t") / block).cast("long")
    halo = placed.where((F.col("_t") % block) >= block - lags).select("*", (own + 1).alias("_b"), F.lit(True).alias("_halo")) if lags else None
    rows = placed.select("*", own.alias("_b"), F.lit(False).alias("_halo"))
    return _hac(fit, rows.unionByName(halo) if lags else rows, ["_b"], ["_t"], x, y, lags, kernel, small)
