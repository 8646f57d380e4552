"""Bootstraps and permutations: weights come from hashes of row keys, so results don't depend on partitions.

Rows are never multiplied by the replicates: a block's B weights are drawn inside the kernel, which adds
up B weighted sums; with clusters, their sums come first and weights fall on them alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlake.operators.linear import Fit, centred_gram, solve_scaled, statistics
from gramlake.operators.rows import PIECE, add_pieces, numpy_columns, pieces_of, sum_rows, sum_rows_by
from gramlake.operators.state import cut
from gramlake.operators.terms import Design

_U = np.uint64


def hashed(key: list[str] | str) -> Column:
    """What tells rows apart: a hash of columns, or an integer SQL expression as it is."""
    return F.expr(key).cast("long") if isinstance(key, str) else F.xxhash64(*key)


def _mixed(h: np.ndarray, numbers: np.ndarray, seed: int) -> np.ndarray:
    """Rows by ``numbers`` 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = h.astype(np.int64).view(np.uint64)[:, None] ^ (numbers * _U(0x9E3779B97F4A7C15) + _U(seed) * _U(0xD1B54A32D192ED03))[None, :]
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def _uniform(h: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Rows by replicates numbers in (0, 1) from hashes."""
    return ((_mixed(h, np.arange(1, replicates + 1, dtype=np.uint64), seed) >> _U(11)).astype(float) + 0.5) / 2.0**53


def weights(h: np.ndarray, replicates: int, kind: str, seed: int) -> np.ndarray:
    """Dirichlet(1) weights up to their sum ("bayesian") or Poisson(1) counts ("classical")."""
    u = _uniform(h, replicates, seed)
    if kind == "bayesian":
        return -np.log(u)
    p = np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1, 20)]))
    return np.searchsorted(np.cumsum(p), u).astype(float)


def replicate_sums(df: DataFrame, key: list[str] | str, kernel: Callable, replicates: int, kind: str = "bayesian", seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sum of weights and of weight * kernel(columns) for each replicate; the kernel gives one row of numbers a row. One pass."""
    rows = df.withColumn("_h", hashed(key)) if key else df

    def each(c):
        w = weights(c["_h"], replicates, kind, seed)
        m = np.asarray(kernel(c), float)
        return np.concatenate([w.sum(0)[:, None], w.T @ m], 1)

    s = sum_rows(rows, each).reshape(replicates, -1)
    return s[:, 0], s[:, 1:]


def bootstrap(df: DataFrame, design: Design, key: list[str] | str, replicates: int, kind: str = "bayesian", cluster: str | None = None, seed: int = 0) -> tuple[Fit, np.ndarray]:
    """Draws of least-squares coefficients (replicates x terms), and a fit whose covariance is theirs.

    ``cluster``: one weight a cluster; one shuffle on it adds up cluster sums, and only these are weighted.
    Otherwise one pass over the rows.
    """
    whole = design.fit(df)
    k = len(whole.names)
    moved, g = centred_gram(whole.rows(df), whole)
    plan = moved.plan

    def products(c):
        m = np.concatenate([plan.matrix(c), plan.outcomes(c)[:, :1] - moved.y[0]], 1)
        return (m[:, :, None] * (m * c["w"][:, None])[:, None, :]).reshape(len(m), -1)

    if cluster:
        rows = plan.rows(df, keep=[F.col(cluster).cast("string").alias("g")])
        sums = sum_rows_by(rows.where("g is not null"), ["g"], products, (k + 1) ** 2).withColumn("_h", hashed("cast(g as long)" if dict(df.dtypes)[cluster] in ("int", "bigint") else ["g"]))
        total, s = replicate_sums(sums.select("_h", "v"), [], lambda c: c["v"], replicates, kind, seed)
    else:
        rows = plan.rows(df, keep=[hashed(key).alias("_h")])
        total, s = replicate_sums(rows, [], products, replicates, kind, seed)
    m = s.reshape(replicates, k + 1, k + 1)
    draws = np.stack([solve_scaled(x[:k, :k], x[:k, k])[0] for x in m])
    draws[:, :1] += moved.y[0]
    beta, bread = solve_scaled(g.xx, g.xy[:, 0])
    stats = statistics(g, beta, plan.names)
    beta[:1] += moved.y[0]
    fit = Fit(plan.names, beta, np.atleast_2d(np.cov(draws.T)), stats["df_resid"], stats, bread, plan)
    return moved.fit(fit, whole), draws @ moved.back.T


def draws_table(spark, names: list[str], draws: np.ndarray) -> DataFrame:
    """replicate, term, value."""
    rows = [(i, n, float(v)) for i, d in enumerate(draws) for n, v in zip(names, d, strict=True)]
    return spark.createDataFrame(rows, "replicate int, term string, value double")


def joint_covariance(tables: dict[str, DataFrame]) -> DataFrame:
    """row, col, value: covariance across fits whose draws share replicates."""
    both = None
    for name, t in tables.items():
        rows = t.select("replicate", F.concat(F.lit(f"{name}."), "term").alias("term"), "value")
        both = rows if both is None else both.unionByName(rows)
    other = both.select("replicate", F.col("term").alias("col"), F.col("value").alias("v2"))
    return both.join(other, "replicate").groupBy(F.col("term").alias("row"), "col").agg(F.covar_samp("value", "v2").alias("value"))


def test_from_draws(table: DataFrame, level: float = 0.95) -> DataFrame:
    """term, lo, hi (quantiles of the draws) and the two-sided p of zero."""
    a = (1 - level) / 2
    low, high = F.avg((F.col("value") <= 0).cast("double")), F.avg((F.col("value") >= 0).cast("double"))
    from gramlake.operators.aggregates import quantiles

    ends = quantiles(table, F.col("value"), [a, 1 - a], ["term"])
    return ends.join(table.groupBy("term").agg(F.least(F.lit(1.0), 2 * F.least(low, high)).alias("p")), "term").select("term", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "p")


#: Rows of a group, or of a part of one, that a task holds to find thresholds; and numbers of a step's block of rows by permutations.
PART_ROWS, BLOCK = 200_000, 4_000_000


def _ordered(h: np.ndarray, first: int, n: int, seed: int) -> np.ndarray:
    """Rows by permutations first, first + 1, ...: the hashes as signed numbers in the same order."""
    return (_mixed(h, np.arange(first, first + n, dtype=np.uint64), seed) ^ _U(1 << 63)).view(np.int64)


def _treated(u: np.ndarray, threshold: np.ndarray, share: np.ndarray) -> np.ndarray:
    """1 for hashes below their permutation's threshold, 0 above; those at it, rows of equal keys, share what is left."""
    return (u < threshold) + (u == threshold) * share


def _thresholds(u: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m-th least of each column, and the share of those equal to it that is among the m least."""
    at = np.partition(u, m - 1, axis=0)[m - 1]
    return at, (m - (u < at).sum(0)) / (u == at).sum(0)


class _Sums:
    """Sums over rows of w T^2, w T e and w T x for each permutation, the observed treatment first."""

    def __init__(self, plan, beta: np.ndarray, permutations: int, seed: int):
        self.plan, self.beta, self.permutations, self.seed = plan, beta, permutations, seed
        self.total = np.zeros((permutations + 1, 2 + len(beta)))

    def values(self, c: dict[str, np.ndarray]) -> np.ndarray:
        x = self.plan.matrix(c)
        return np.concatenate([np.ones((len(x), 1)), (self.plan.outcomes(c)[:, 0] - x @ self.beta)[:, None], x], 1) * c["w"][:, None]

    def add(self, c: dict[str, np.ndarray], limits=None) -> None:
        """``limits``: thresholds and shares of every permutation; None: those of these rows, a whole group."""
        v, h = self.values(c), c["_h"].astype(np.int64)
        self.total[0] += c["_t"] @ v
        m, n = int(c["_t"].sum()), len(h)
        if limits is None and m in (0, n):
            self.total[1:] += v.sum(0) if m else 0.0
            return
        step = max(1, BLOCK // n)
        for first in range(1, self.permutations + 1, step):
            count = min(step, self.permutations + 1 - first)
            u = _ordered(h, first, count, self.seed)
            at = slice(first - 1, first - 1 + count)
            threshold, share = _thresholds(u, m) if limits is None else (limits[0][at], limits[1][at])
            treated = _treated(u, threshold, share)
            self.total[first : first + count] += treated.T @ v
            if (share < 1).any():  # where rows share a place, T^2 is less than T
                self.total[first : first + count, 0] -= (treated * (1 - treated)).T @ v[:, 0]

    def pieces(self):
        flat = self.total.ravel()
        return pieces_of(enumerate(flat[i : i + PIECE] for i in range(0, len(flat), PIECE)))


def _runs(batches, keys: tuple[str, ...], whole: bool):
    """Arrow rows of each run of equal keys, at once if ``whole`` and else as they come."""
    held, key = [], None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows else []
        for a, b in zip([0, *change], [*change, batch.num_rows], strict=True):
            if a == b:
                continue
            now = tuple(c[a] for c in columns)
            if whole and held and now != key:
                yield key, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            key = now
            if whole:
                held.append(batch.slice(a, b - a))
            else:
                yield key, batch.slice(a, b - a)
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def permute_coefficient(df: DataFrame, design: Design, treatment: str, key: list[str] | str, group: str, permutations: int, seed: int = 0, part: int = PART_ROWS) -> DataFrame:
    """permutation, coef: the coefficient of a 0/1 treatment in the design, refitted after shuffling it within groups (0: as observed).

    Other columns are partialled out once, so that a refit needs three sums over its treated rows. Those of permutation b are a group's rows with
    the least hashes of ``key`` and b, as many as are treated; no row is multiplied or sorted for a permutation. Groups of up to ``part`` rows
    move once, narrow, to one task each, which finds all their thresholds. Larger ones are dealt in parts: a first pass counts
    the hashes below the bracket in which a threshold lies (but for one time in a billion, when it is widened) and keeps those inside, about the root
    of the group's rows; a second adds up. Rows with a null group or another treatment are left out. ``key`` should tell rows apart.
    """
    valid = df.where(F.col(group).isNotNull() & F.col(treatment).isin(0, 1))
    whole = design.fit(valid)
    rows = whole.rows(valid, keep=[F.col(group).cast("string").alias("_g"), F.col(treatment).cast("double").alias("_t"), hashed(key).alias("_h")])
    moved, g = centred_gram(rows, whole)
    beta, bread = solve_scaled(g.xx, g.xy[:, 0])
    beta[:1] += moved.y[0]
    plan, k = moved.plan, len(beta)
    sizes = rows.groupBy("_g").agg(F.count("*").alias("_n"), F.sum("_t").alias("_m"))
    sized = rows.join(sizes, "_g")
    names = [c for c in rows.columns if c not in ("_g",)]
    schema = "i int, b binary"

    def small(batches):
        sums = _Sums(plan, beta, permutations, seed)
        for _, batch in _runs(batches, ("_g",), True):
            sums.add(numpy_columns(batch.select(names)))
        yield sums.pieces()

    # by a hash of the group: where the join lies by the group already, Spark drops a shuffle and sort by it, and may then broadcast the sizes and leave rows as they lay
    place = F.xxhash64("_g").alias("_place")
    dealt = sized.where(F.col("_n") <= part).select("_g", *names, place).repartition("_place").sortWithinPartitions("_place", "_g")
    total = np.zeros((permutations + 1) * (k + 2))
    parts = [dict(add_pieces(dealt, small, whole=False))]
    salts = F.ceil(F.col("_n") / part).cast("int")
    large = sized.where((F.col("_n") > part) & (F.col("_m") > 0))
    if large.limit(1).count():
        limits = cut(_limits(large, permutations, seed))
        columns = [F.col(c) for c in names]
        stream = large.select("_g", F.pmod("_h", salts).cast("int").alias("_s"), F.lit(1).alias("_kind"), *columns, F.lit(None).cast("array<long>").alias("_at"), F.lit(None).cast("array<double>").alias("_share"))
        marks = limits.join(sizes, "_g").select("_g", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_s"), F.lit(0).alias("_kind"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names], "_at", "_share")
        stream = stream.unionByName(marks).repartition("_g", "_s").sortWithinPartitions("_g", "_s", "_kind")

        def apart(batches):
            sums, limit = _Sums(plan, beta, permutations, seed), None
            for _, batch in _runs(batches, ("_g", "_s", "_kind"), False):
                if not batch.column(2)[0].as_py():
                    limit = tuple(np.asarray(batch.column(batch.schema.get_field_index(c))[0].as_py()) for c in ("_at", "_share"))
                else:
                    sums.add(numpy_columns(batch.select(names)), limit)
            yield sums.pieces()

        parts.append(dict(add_pieces(stream, apart, whole=False)))
    for found in parts:
        for i, p in found.items():
            total[i * PIECE : i * PIECE + len(p)] += p
    s = total.reshape(permutations + 1, k + 2)
    left = s[:, 0] - np.einsum("bi,ij,bj->b", s[:, 2:], bread, s[:, 2:])
    with np.errstate(divide="ignore", invalid="ignore"):
        coef = np.where(left > 1e-10 * np.maximum(s[:, 0], 1e-300), s[:, 1] / left, np.nan)
    out = [(b, None if math.isnan(v) else float(v)) for b, v in enumerate(coef)]
    return df.sparkSession.createDataFrame(out, "permutation int, coef double")


def _limits(large: DataFrame, permutations: int, seed: int) -> DataFrame:
    """_g, and for every permutation the threshold ``_at`` and the ``_share`` of the rows at it: arrays."""
    rows, spread = large.select("_g", "_h", "_n", "_m").sortWithinPartitions("_g"), 6.5
    while True:

        def counted(batches, spread=spread):
            below: dict[str, np.ndarray] = {}
            for group, batch in _runs(batches, ("_g",), False):
                h, n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                p = m[0] / n[0]
                width = spread * math.sqrt(max(p * (1 - p), 1 / n[0]) / n[0])
                low, high = (int(min(max(x, 0.0), 1.0) * (2**64 - 1)) - 2**63 for x in (p - width, p + width))
                count = below.setdefault(group[0], np.zeros(permutations, np.int64))
                step = max(1, BLOCK // len(h))
                for first in range(1, permutations + 1, step):
                    u = _ordered(h.astype(np.int64), first, min(step, permutations + 1 - first), seed)
                    count[first - 1 : first - 1 + u.shape[1]] += (u < low).sum(0)
                    row, b = np.nonzero((u >= low) & (u <= high))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), group[0], object), pa.string()), pa.array((first + b).astype(np.int32)), pa.array(u[row, b]), pa.array(np.zeros(len(row), np.int64))], ["_g", "b", "u", "n"])
            for group, count in below.items():
                yield pa.RecordBatch.from_arrays([pa.array([group] * permutations, pa.string()), pa.array(np.arange(1, permutations + 1, dtype=np.int32)), pa.nulls(permutations, pa.int64()), pa.array(count)], ["_g", "b", "u", "n"])

        found = cut(rows.mapInArrow(counted, "_g string, b int, u long, n long"))
        below = found.groupBy("_g", "b").agg(F.sum("n").alias("below"))
        inside = found.where("u is not null").groupBy("_g", "b", "u").agg(F.count("*").alias("c"))
        upto = inside.withColumn("upto", F.sum("c").over(Window.partitionBy("_g", "b").orderBy("u")))  # about the root of a group's rows
        sizes = rows.groupBy("_g").agg(F.max("_m").cast("long").alias("m"))
        placed = upto.join(below, ["_g", "b"]).join(F.broadcast(sizes), "_g").where((F.col("below") < F.col("m")) & (F.col("below") + F.col("upto") >= F.col("m")))
        first = placed.groupBy("_g", "b").agg(F.min_by(F.struct(F.col("u"), ((F.col("m") - F.col("below") - F.col("upto") + F.col("c")) / F.col("c")).alias("share")), "u").alias("l"))
        out = cut(first.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("b", "l"))).alias("a")).select("_g", F.transform("a", lambda x: x["l"]["u"]).alias("_at"), F.transform("a", lambda x: x["l"]["share"]).alias("_share")))
        whole = out.where(F.size("_at") == permutations).count()
        if whole == sizes.count():
            return out
        spread *= 8


def permutation_test(df: DataFrame, y: str, treatment: str, key: list[str] | str, group: str, permutations: int, seed: int = 0) -> DataFrame:
    """permutation, effect: difference of treated and other means after shuffling treatment within groups (0: as observed)."""
    return permute_coefficient(df, Design([y], []), treatment, key, group, permutations, seed).withColumnRenamed("coef", "effect")
