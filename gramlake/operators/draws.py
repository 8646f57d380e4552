"""Posterior analytics: the conjugate linear model, and diagnostics over tables of draws (chain, draw, param, value)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gramlake.operators.aggregates import quantiles
from gramlake.operators.linear import Gram


def blm(g: Gram, names: list[str], mean: np.ndarray | None = None, precision: np.ndarray | None = None, a0: float = 0.0, b0: float = 0.0) -> dict:
    """Normal-inverse-gamma posterior from the sums: mean, precision, a, b. Without a prior precision the prior is flat."""
    k = len(names)
    m0 = np.zeros(k) if mean is None else np.asarray(mean, float)
    l0 = np.zeros((k, k)) if precision is None else np.asarray(precision, float)
    ln = g.xx + l0
    mn = np.linalg.solve(ln, g.xy[:, 0] + l0 @ m0)
    flat = precision is None
    a = a0 + (g.n - (k if flat else 0)) / 2
    b = b0 + 0.5 * float(g.yy[0, 0] + m0 @ l0 @ m0 - mn @ ln @ mn)
    return {"names": names, "mean": mn, "precision": ln, "a": a, "b": b, "sd": np.sqrt(np.diag(np.linalg.inv(ln)) * b / a)}


def posterior_table(spark, post: dict, level: float = 0.95) -> DataFrame:
    """term, mean, scale, lo, hi: equal-tail intervals of the marginal t."""
    from gramlake.functions.special import t_ppf

    t = t_ppf(0.5 + level / 2, 2 * post["a"])
    return spark.createDataFrame([(n, float(m), float(s), float(m - t * s), float(m + t * s)) for n, m, s in zip(post["names"], post["mean"], post["sd"], strict=True)], "term string, mean double, scale double, lo double, hi double")


def rhat(draws: DataFrame, split: int = 2) -> DataFrame:
    """param, rhat, n_eff: between and within variance of chain segments. Two aggregates; a window by chain gives the segments."""
    w = Window.partitionBy("param", "chain")
    place = F.row_number().over(w.orderBy("draw")) - 1
    size = F.floor(F.count("*").over(w) / split)
    cut = draws.withColumn("_p", place).withColumn("_s", size).where(F.col("_p") < F.col("_s") * split).withColumn("_seg", F.floor(F.col("_p") / F.col("_s")))
    seg = cut.groupBy("param", "chain", "_seg").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    a = seg.groupBy("param").agg(F.avg("n").alias("n"), F.count("*").alias("k"), F.avg("v").alias("w"), (F.var_samp("m") * F.avg("n")).alias("b"))
    plus = (F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b") / F.col("n")
    return a.select("param", F.sqrt(plus / F.col("w")).alias("rhat"), (F.col("n") * F.col("k") * plus / F.col("b")).alias("n_eff"))


def batch_variance(draws: DataFrame, tau: float = 0.5) -> DataFrame:
    """param, n, var_mean: variance of the mean by batch means, batches of n^tau draws of a chain."""
    w = Window.partitionBy("param", "chain")
    d = draws.withColumn("_p", F.row_number().over(w.orderBy("draw")) - 1).withColumn("_n", F.count("*").over(w)).withColumn("_b", F.floor(F.pow("_n", tau)))
    batches = d.where(F.col("_p") < F.floor(F.col("_n") / F.col("_b")) * F.col("_b")).groupBy("param", "chain", F.floor(F.col("_p") / F.col("_b")).alias("batch"), "_b").agg(F.avg("value").alias("m"))
    return batches.groupBy("param").agg((F.sum("_b")).alias("n"), (F.var_samp("m") / F.count("*")).alias("var_mean"))


def ess_batch_means(draws: DataFrame, taus: list[float]) -> DataFrame:
    """param, ess: draws' variance over the largest batch-means variance of the mean on the grid."""
    parts = None
    for t in taus:
        p = batch_variance(draws, t)
        parts = p if parts is None else parts.unionByName(p)
    worst = parts.groupBy("param").agg(F.max("var_mean").alias("vm"))
    return draws.groupBy("param").agg(F.var_samp("value").alias("v")).join(worst, "param").select("param", (F.col("v") / F.col("vm")).alias("ess"))


def joint_ess(draws: DataFrame, params: list[str], taus: list[float]) -> float:
    """Effective size of all parameters together: the p-th root of the draws' generalized variance over that of their mean.

    The mean's covariance is that of batch means, vectors of batches of n^tau draws of a chain; of the grid's, the largest determinant counts.
    Draws that lack a parameter are left out. A window by chain and an aggregate for each tau; what reaches the driver is p x p numbers.
    """
    p = len(params)
    wide = draws.where(F.col("param").isin(params)).groupBy("chain", "draw").pivot("param", params).agg(F.first("value")).na.drop()
    names = [f"_v{i}" for i in range(p)]
    wide = wide.select("chain", "draw", *[F.col(f"`{c}`").alias(n) for c, n in zip(params, names, strict=True)])
    w = Window.partitionBy("chain")
    placed = wide.withColumn("_p", F.row_number().over(w.orderBy("draw")) - 1).withColumn("_n", F.count("*").over(w)).persist()

    def determinant(rows: DataFrame) -> tuple[float, int]:
        r = rows.agg(F.count("*").alias("n"), *[F.covar_samp(names[i], names[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]).first()
        m = [[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]
        return (math.nan if r.n < 2 else float(np.linalg.det(np.array(m, float)))), r.n

    try:
        whole, _ = determinant(placed)
        worst = 0.0
        for tau in taus:
            size = F.floor(F.pow("_n", F.lit(float(tau))))
            batches = placed.where(F.col("_p") < F.floor(F.col("_n") / size) * size).groupBy("chain", F.floor(F.col("_p") / size).alias("batch")).agg(*[F.avg(c).alias(c) for c in names])
            value, count = determinant(batches)
            worst = max(worst, value / float(count) ** p) if count > 1 else worst
    finally:
        placed.unpersist()
    return (whole / worst) ** (1 / p) if worst > 0 else math.nan


def geweke(draws: DataFrame, first: float = 0.1, last: float = 0.5) -> DataFrame:
    """param, chain, z: difference of early and late means over their batch-free standard error."""
    w = Window.partitionBy("param", "chain")
    share = (F.row_number().over(w.orderBy("draw")) - 1) / F.count("*").over(w)
    d = draws.withColumn("_q", share)
    early, late = F.when(F.col("_q") < first, F.col("value")), F.when(F.col("_q") >= 1 - last, F.col("value"))
    g = d.groupBy("param", "chain").agg(F.avg(early).alias("a"), F.avg(late).alias("b"), (F.var_samp(early) / F.count(early)).alias("va"), (F.var_samp(late) / F.count(late)).alias("vb"))
    return g.select("param", "chain", ((F.col("a") - F.col("b")) / F.sqrt(F.col("va") + F.col("vb"))).alias("z"))


def draws_summary(draws: DataFrame, burn_in: int = 0, thin: int = 1, level: float = 0.95) -> DataFrame:
    """param, n, mean, sd, q_lo, median, q_hi after burn-in and thinning."""
    kept = draws.where((F.col("draw") >= burn_in) & ((F.col("draw") - burn_in) % thin == 0))
    a = (1 - level) / 2
    moments = kept.groupBy("param").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    q = quantiles(kept, F.col("value"), [a, 0.5, 1 - a], ["param"]).select("param", "q")
    return moments.join(q, "param").select("param", "n", "mean", "sd", *[F.col("q")[i].alias(c) for i, c in enumerate(("q_lo", "median", "q_hi"))])


def transform_draws(draws: DataFrame, params: list[str], sql: str, name: str) -> DataFrame:
    """chain, draw, param = name, value: an expression over the parameters of each draw."""
    wide = draws.groupBy("chain", "draw").pivot("param", params).agg(F.first("value"))
    return wide.select("chain", "draw", F.lit(name).alias("param"), F.expr(sql).cast("double").alias("value"))


def simulate_test(spark, params: np.ndarray, cov: np.ndarray, func, draws: int = 10_000, seed: int = 0) -> dict:
    """Interval and two-sided p of a function of normal parameters; the draws are made on the executors from hashed seeds."""
    import pyarrow as pa

    chol = np.linalg.cholesky(np.asarray(cov, float) + 1e-300 * np.eye(len(params)))

    def make(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            z = np.stack([np.random.default_rng([seed, int(i)]).standard_normal(len(params)) for i in ids]) if len(ids) else np.zeros((0, len(params)))
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray([func(p) for p in params + z @ chol.T], float))], ["value"])

    t = spark.range(draws).mapInArrow(make, "value double")
    q = quantiles(t, F.col("value"), [0.025, 0.975]).first().q
    r = t.agg(F.avg((F.col("value") <= 0).cast("double")).alias("lo"), F.avg((F.col("value") >= 0).cast("double")).alias("hi"), F.stddev_samp("value").alias("sd")).first()
    return {"value": float(func(np.asarray(params))), "lo": q[0], "hi": q[1], "sd": r.sd, "p": min(1.0, 2 * min(r.lo, r.hi)) if not math.isnan(r.lo) else math.nan}
