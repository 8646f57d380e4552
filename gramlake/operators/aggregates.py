"""Aggregates: moments, histograms, scale, distributions by maximum likelihood, shortest intervals."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlake.functions import special
from gramlake.operators.rows import sum_rows
from gramlake.operators.state import cut
from gramlake.operators.terms import finite


def merge_moments(batches: DataFrame, by: list[str] = ()) -> DataFrame:
    """Exact (n, mean, m2) of the union of batches with columns n, mean, m2 (sum of squared deviations). One aggregate."""
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    # about a common origin: the deviations of means are small beside it, so m2 loses no digits to the raw squares
    w = Window.partitionBy(*by) if by else None
    if w is None:
        origin = batches.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_o"))
        joined = batches.crossJoin(F.broadcast(origin))  # one row
    else:
        joined = batches.join(batches.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_o")), list(by))
    return joined.groupBy(*by).agg(n.alias("n"), mean.alias("mean"), (F.sum("m2") + F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_o"), 2))).alias("m2"))


def weighted_moments(df: DataFrame, x: str, weight: str | None = None, by: list[str] = ()) -> DataFrame:
    """n, sw, mean, raw and centred (weighted) sums of squares."""
    v, w = F.col(x).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    ok = df.where(finite(v) & finite(w) & (w > 0))
    return ok.groupBy(*by).agg(F.count("*").alias("n"), F.sum(w).alias("sw"), (F.sum(w * v) / F.sum(w)).alias("mean"), F.sum(w * v * v).alias("raw_ss"), (F.var_pop(v) * F.count("*") if not weight else F.sum(w * v * v) - F.pow(F.sum(w * v), 2) / F.sum(w)).alias("centred_ss"))


def histogram(df: DataFrame, x: str, lo: float, hi: float, nbins: int, density: bool = False, by: list[str] = ()) -> DataFrame:
    """by, bin, left, count (or density): equal bins on [lo, hi]; values outside fall in the end bins; empty bins are there."""
    v = F.col(x).cast("double")
    width = (hi - lo) / nbins
    bin_ = F.least(F.greatest(F.floor((v - lo) / width), F.lit(0)), F.lit(nbins - 1)).cast("int")
    counts = df.where(finite(v)).groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("count"))
    spark = df.sparkSession
    if by:
        full = df.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))).alias("bin"))
    else:
        full = spark.range(nbins).select(F.col("id").cast("int").alias("bin"))
    out = full.join(counts, [*by, "bin"], "left").select(*by, "bin", (F.lit(lo) + F.col("bin") * width).alias("left"), F.coalesce("count", F.lit(0)).alias("count"))
    if density:
        total = F.sum("count").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))  # nbins rows a group
        out = out.withColumn("density", F.col("count") / (total * width))
    return out


def exact_quantile(df: DataFrame, value: Column, share: float, bins: int = 1024, keep: int = 100_000) -> float:
    """Exact quantile (linear between order statistics) by counting passes that narrow a bracket; no sort of all rows.

    Each pass counts ``bins`` bins of the bracket; when at most ``keep`` values are left inside, those alone are sorted.
    """
    v = df.select(value.cast("double").alias("v")).where(finite(F.col("v")))
    n, lo, hi = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return math.nan
    pos = share * (n - 1)
    want = (int(math.floor(pos)), min(int(math.floor(pos)) + 1, n - 1))

    def between(first: float, second: float) -> float:
        return first if pos == want[0] or first == second else first + (pos - want[0]) * (second - first)

    a, b, below = lo, hi, 0  # both ranks lie in the bracket
    while a < b:
        width = (b - a) / bins
        inside = v.where((F.col("v") >= a) & (F.col("v") <= b))
        counts = {r.b: (r.n, r.lo, r.hi) for r in inside.groupBy(F.least(F.floor((F.col("v") - a) / width), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
        for i in sorted(counts):
            if below + counts[i][0] > want[0]:
                break
            below += counts[i][0]
        m, a, b = counts[i]
        if below + m <= want[1]:  # the bin's last value and the next one's first
            return between(b, min((counts[j][1] for j in counts if j > i), default=b))
        if m <= keep:
            rows = v.where((F.col("v") >= a) & (F.col("v") <= b)).orderBy("v").limit(want[1] - below + 1).collect()  # at most keep
            return between(rows[want[0] - below].v, rows[want[1] - below].v)
    return a


#: Values of a bracket that are sorted as one list, and bins that a larger one is counted in.
KEEP, BINS = 50_000, 256


def quantiles(df: DataFrame, value: Column, shares: list[float], by: list[str] = (), keep: int = KEEP, bins: int = BINS) -> DataFrame:
    """by, n, q: the exact quantiles of every group (linear between order statistics), an array in the order of ``shares``.

    Brackets of values, at first a group's whole range, are counted in bins until those that hold a wanted rank have ``keep`` values at
    most; these alone are sorted, each bracket by itself. A pass adds up (group, bin) counts before it shuffles them, so a group
    of any size sends a few numbers a task; rows meet their bracket by a join on the group, whose skewed side can be split, and only rows
    of brackets that hold a wanted rank go on. Groups with no finite value aren't there; null is a group of its own.
    """
    by = list(by)
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], value.cast("double").alias("v"), F.lit("").alias("b")).where(finite(F.col("v")))
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0")
    at = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    ranks = F.array_distinct(F.concat(F.array(*[F.floor(p) for p in at]), F.array(*[F.ceil(p) for p in at])))
    sizes = cut(sizes.withColumn("ranks", ranks))
    brackets = sizes.select(*keys, F.lit("").alias("b"), F.lit(0).cast("long").alias("below"), F.col("n").alias("m"), "lo", "hi", "ranks")
    found = []

    def met(rows: DataFrame, brackets: DataFrame, columns: list[str], on_left: list[str]) -> DataFrame:
        """Rows with their bracket's ``columns``: ends alone for values, as ranks are long and go with brackets only."""
        other = brackets.select(*[F.col(c).alias(f"o_{c}") for c in brackets.columns])
        on = rows["b"] == other["o_b"]
        for k in keys:
            on = on & rows[k].eqNullSafe(other[f"o_{k}"])
        return rows.join(other, on).select(*keys, *on_left, *[F.col(f"o_{c}").alias(c) for c in columns])

    for turn in itertools.count():
        same = brackets.where("lo = hi").select(*keys, F.explode("ranks").alias("rank"), F.col("lo").alias("value"))
        small = brackets.where((F.col("m") <= keep) & (F.col("lo") < F.col("hi")))
        lists = met(rows, small, [], ["v", "b"]).groupBy(*keys, "b").agg(F.sort_array(F.collect_list("v")).alias("l"))  # keep values at most
        lists = met(lists, small, ["below", "ranks"], ["b", "l"])
        sorted_ = lists.select(*keys, "below", "l", F.explode("ranks").alias("rank")).select(*keys, "rank", F.element_at("l", (F.col("rank") - F.col("below") + 1).cast("int")).alias("value"))
        found += [same, sorted_]
        more = brackets.where((F.col("m") > keep) & (F.col("lo") < F.col("hi")))
        if not more.limit(1).count():
            break
        inside = met(rows, more, ["lo", "hi"], ["v", "b"]).withColumn("part", _part(bins)).drop("lo", "hi")
        inside = cut(inside) if turn else inside  # after the first round, few rows are left
        counts = inside.groupBy(*keys, "b", "part").agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        counts = met(counts, more.withColumn("start", F.col("below")), ["start", "ranks"], ["b", "part", "m", "low", "high"])
        upto = F.sum("m").over(Window.partitionBy(*keys, "b").orderBy("part"))  # bins rows
        below = counts.withColumn("below", F.col("start") + upto - F.col("m"))
        wanted = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("m")))
        brackets = cut(below.withColumn("ranks", wanted).where(F.size("ranks") > 0).select(*keys, F.concat_ws(".", "b", F.col("part").cast("string")).alias("b"), "below", "m", F.col("low").alias("lo"), F.col("high").alias("hi"), "ranks"))
        rows = inside.select(*keys, "v", F.concat_ws(".", "b", F.col("part").cast("string")).alias("b"))
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    table = whole.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("values"))
    named = table.select(*[F.col(k).alias(f"o_{k}") for k in keys], "values")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"o_{k}"))
    joined = sizes.join(named, on)
    q = F.transform(F.array(*[F.lit(float(s)) for s in shares]), lambda s: _between(s * (F.col("n") - 1)))
    return joined.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "n", q.alias("q"))


def _part(bins: int) -> Column:
    """The bin of v in its bracket from lo to hi, never falling in v, lo and hi apart: even ones, in logarithms where a bracket spans magnitudes, and by sign first."""
    v, lo, hi, half = F.col("v"), F.col("lo"), F.col("hi"), max(1, bins // 2)
    even = lambda a, z, n: F.least(F.greatest(F.floor(a / z * n), F.lit(0)), F.lit(n - 1))
    signed = F.when(v < 0, even(v - lo, -lo, half)).when(v == 0, half).otherwise(half + 1 + even(v, hi, half))
    logs = F.when(lo > 0, even(F.log(v) - F.log(lo), F.log(hi) - F.log(lo), bins)).otherwise(even(F.log(-lo) - F.log(-v), F.log(-lo) - F.log(-hi), bins))
    return F.when((lo <= 0) & (hi >= 0), signed).when((hi / lo > 4) | (lo / hi > 4), logs).otherwise(even(v - lo, hi - lo, bins)).cast("long")


def _between(at: Column) -> Column:
    """The value at a rank that may lie between two."""
    low, high = F.floor(at), F.ceil(at)
    return F.when(low == high, F.col("values")[low]).otherwise((high - at) * F.col("values")[low] + (at - low) * F.col("values")[high])


def mad_scale(df: DataFrame, resid: Column) -> float:
    """Median of |r| over the normal's 0.75 quantile; not recentred."""
    return exact_quantile(df, F.abs(resid), 0.5) / special.norm_ppf(0.75)


def fit_distribution(df: DataFrame, x: str, kind: str, by: list[str] = ()) -> DataFrame:
    """Maximum-likelihood parameters: norm (loc, scale), expon (loc, scale), lognorm (s, scale; location 0). One aggregate."""
    v = F.col(x).cast("double")
    ok = df.where(finite(v))
    if kind == "norm":
        return ok.groupBy(*by).agg(F.avg(v).alias("loc"), F.stddev_pop(v).alias("scale"))
    if kind == "expon":
        return ok.groupBy(*by).agg(F.min(v).alias("loc"), (F.avg(v) - F.min(v)).alias("scale"))
    if kind == "lognorm":
        return ok.where(v > 0).groupBy(*by).agg(F.stddev_pop(F.log(v)).alias("s"), F.exp(F.avg(F.log(v))).alias("scale"))
    raise ValueError(f"unknown distribution {kind}; t is fit_t")


def fit_t(df: DataFrame, x: str, iterations: int = 200, tol: float = 1e-8) -> dict:
    """Degrees of freedom, location and scale of Student's t by EM passes; the degrees by a bounded search on grid sums."""
    rows = df.select(F.col(x).cast("double").alias("x")).where(finite(F.col("x")))
    n, loc, scale = rows.agg(F.count("*"), F.avg("x"), F.stddev_pop("x")).first()
    df_ = 5.0
    for _ in range(iterations):

        def step(c, loc=loc, scale=scale, df_=df_):
            z = (c["x"] - loc) / scale
            w = (df_ + 1) / (df_ + z * z)
            return np.array([w.sum(), (w * c["x"]).sum(), (w * c["x"] ** 2).sum(), (np.log(w) - w).sum()])

        s = sum_rows(rows, step)
        new_loc = s[1] / s[0]
        new_scale = math.sqrt(max((s[2] - 2 * new_loc * s[1] + new_loc**2 * s[0]) / n, 1e-300))
        target = s[3] / n + float(special.digamma((df_ + 1) / 2) - math.log((df_ + 1) / 2))
        low, high = 0.05, 1e6
        for _ in range(100):
            mid = math.sqrt(low * high)
            low, high = (mid, high) if -float(special.digamma(mid / 2)) + math.log(mid / 2) + 1 + target > 0 else (low, mid)
        change = max(abs(new_loc - loc), abs(new_scale - scale), abs(mid - df_) / max(1.0, df_))
        loc, scale, df_ = new_loc, new_scale, mid
        if change < tol:
            break
    return {"df": df_, "loc": loc, "scale": scale}


def distribution_curve(spark, kind: str, lo: float, hi: float, points: int, **parameters: float) -> DataFrame:
    """x, pdf on an even grid."""
    from gramlake.functions.columns import pdf

    grid = spark.range(points).select((F.lit(lo) + F.col("id") * ((hi - lo) / max(points - 1, 1))).alias("x"))
    loc, scale = (F.lit(float(parameters.pop(k, d))) for k, d in (("loc", 0.0), ("scale", 1.0)))
    return grid.select("x", pdf(kind, F.col("x"), loc, scale, **parameters).alias("pdf"))


def hdi(df: DataFrame, x: str, level: float = 0.95, by: list[str] = (), points: int = 1001) -> DataFrame:
    """by, lo, hi: the shortest interval between grid quantiles that holds ``level``. Exact quantiles by counting passes."""
    q = quantiles(df, F.col(x), [i / (points - 1) for i in range(points)], by)
    gap = int(round(level * (points - 1)))
    ends = F.transform(F.sequence(F.lit(1), F.lit(points - gap)), lambda i: F.struct((F.element_at("q", i + gap) - F.element_at("q", i)).alias("w"), F.element_at("q", i).alias("lo"), F.element_at("q", i + gap).alias("hi")))
    return q.select(*by, F.array_min(ends).alias("e")).select(*by, "e.lo", "e.hi")


def within_between_r2(df: DataFrame, y: str, by: list[str], fitted: str) -> DataFrame:
    """Squared correlation of outcome and fit inside groups, and of the group means."""
    a, b = F.col(y).cast("double"), F.col(fitted).cast("double")
    g = df.where(finite(a) & finite(b)).groupBy(*by).agg(F.count("*").alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), (F.covar_pop(a, b) * F.count("*")).alias("ab"), (F.var_pop(a) * F.count("*")).alias("aa"), (F.var_pop(b) * F.count("*")).alias("bb"))
    return g.agg((F.pow(F.sum("ab"), 2) / (F.sum("aa") * F.sum("bb"))).alias("r2_within"), F.pow(F.corr("ma", "mb"), 2).alias("r2_between"))
