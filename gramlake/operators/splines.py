"""Splines through knot tables of any size: the tridiagonal system is split over blocks of knots, and rows meet pieces by blocks.

A block is reduced to how its first and last unknown follow its neighbours' nearest ones; the driver solves those borders, two
numbers for each BLOCK knots; then every block is filled in by itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlake.operators.terms import finite
from gramlake.operators.windows import global_index

#: Knots of a block, which one task holds (the last block up to twice as many), and rows of a block that one task evaluates.
BLOCK, ROWS = 100_000, 1_000_000
_PIECE = "lo double, at double, a double, b double, c double, d double"


def _equations(kind: str, bc: str, t: np.ndarray, x: np.ndarray, y: np.ndarray, n: int, core: slice) -> tuple[np.ndarray, ...]:
    """low, diagonal, high and right side of the core's unknowns, from knots with one before and two after the core where there are any.

    Cubic: half the second derivative at each knot. Quadratic: the slope in the middle of each gap; the one after the last knot is 0.
    """
    h = np.append(np.diff(x), np.nan)
    d = np.append(np.diff(y), np.nan) / h
    before = lambda v: np.concatenate(([np.nan], v[:-1]))
    after = lambda v: np.append(v[1:], np.nan)
    inner = (t > 0) & (t < (n - 1 if kind == "cubic" else n - 2))
    low, diagonal, high, r = np.zeros(len(t)), np.ones(len(t)), np.zeros(len(t)), np.zeros(len(t))
    if kind == "cubic":
        own = before(h), 2 * (before(h) + h), h, 3 * (d - before(d))
    else:
        left, right = before(h) + h, h + after(h)
        own = h / left, 2 + before(h) / left + after(h) / right, h / right, 4 * d
        r = np.where((t == 0) | (t == n - 2), d, 0.0)
    low, diagonal, high, r = (np.where(inner, new, old) for new, old in zip(own, (low, diagonal, high, r), strict=True))
    if kind == "cubic" and bc == "clamped":
        first, last = t == 0, t == n - 1
        diagonal = np.where(first, 2 * h, np.where(last, 2 * before(h), diagonal))
        high, low = np.where(first, h, high), np.where(last, before(h), low)
        r = np.where(first, 3 * d, np.where(last, -3 * before(d), r))
    elif kind == "cubic" and bc == "not-a-knot":  # the end unknowns follow from their two neighbours and leave the system
        p, q = before(h), h
        for at, near, far in ((t == 1, p, q), (t == n - 2, q, p)):
            diagonal = np.where(at, diagonal + near * (p + q) / far, diagonal)
            inwards = far - near**2 / far
            low, high = (np.where(at, 0.0, low), np.where(at, inwards, high)) if near is p else (np.where(at, inwards, low), np.where(at, 0.0, high))
    return low[core], diagonal[core], high[core], r[core]


def _sweep(low: np.ndarray, diagonal: np.ndarray, high: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """The tridiagonal system's solutions for each column of ``sides``: one sweep down, one up."""
    k = sides.shape[1]
    low, high, pivot, r = low.tolist(), high.tolist(), diagonal.tolist(), sides.tolist()
    for i in range(1, len(r)):
        f = low[i] / pivot[i - 1]
        pivot[i] -= f * high[i - 1]
        r[i] = [r[i][j] - f * r[i - 1][j] for j in range(k)]
    r[-1] = [v / pivot[-1] for v in r[-1]]
    for i in range(len(r) - 2, -1, -1):
        r[i] = [(r[i][j] - high[i] * r[i + 1][j]) / pivot[i] for j in range(k)]
    return np.array(r)


def _borders(parts: list) -> tuple[list[float], list[float]]:
    """Every block's first and last unknown, from each one's (u, v, w) at both ends: unknown = u - v * (the last before) - w * (the first after).

    Going down, a block's last unknown is a + b * (the next block's first one); going up, those are put in.
    """
    a, b, firsts, lasts = 0.0, 0.0, [], []
    for (uf, vf, wf), (ul, vl, wl) in parts:
        k = 1 + vf * b
        c, e = (uf - vf * a) / k, -wf / k
        firsts.append((c, e))
        a, b = ul - vl * (a + b * c), -vl * b * e - wl
        lasts.append((a, b))
    after, first, last = 0.0, [], []
    for (c, e), (a, b) in zip(reversed(firsts), reversed(lasts), strict=True):
        last.append(a + b * after)
        after = c + e * after
        first.append(after)
    return first[::-1], last[::-1]


def _pieces(kind: str, bc: str, t: np.ndarray, x: np.ndarray, y: np.ndarray, n: int, core: slice, z: np.ndarray, before: float, after: float) -> np.ndarray:
    """Rows lo, at, a, b, c, d of the core's pieces: a + b u + c u2 + d u3 with u = value - at, from lo on. ``z`` has the core's unknowns."""
    own, ends = np.arange(len(t))[core], (t[core][0], t[core][-1])
    if kind == "linear":
        i = own[t[core] < n - 1]
        return np.stack([x[i], x[i], y[i], (y[i + 1] - y[i]) / (x[i + 1] - x[i]), 0 * x[i], 0 * x[i]], 1)
    h = np.diff(x)
    if kind == "quadratic":
        z = np.concatenate(([before], z))  # z[k + 1] is the core's k-th
        keep = (t[core] > 0) & (t[core] < n - 1)
        i, k = own[keep], np.flatnonzero(keep)
        left, right, c = z[k], z[k + 1], (z[k + 1] - z[k]) / (h[i - 1] + h[i])
        lo = np.where(t[i] == 1, x[i - 1], (x[i - 1] + x[i]) / 2)
        return np.stack([lo, x[i], y[i], (left * h[i] + right * h[i - 1]) / (h[i - 1] + h[i]), c, 0 * c], 1)
    z, at = np.append(z, after), own[0]
    if bc == "not-a-knot":
        if ends[0] == 0:
            z[0] = ((h[at] + h[at + 1]) * z[1] - h[at] * z[2]) / h[at + 1]
        if ends[1] == n - 1:
            m = own[-1] - 1
            z[-2] = ((h[m] + h[m - 1]) * z[-3] - h[m] * z[-4]) / h[m - 1]
    i = own[t[core] < n - 1]
    c, then = z[: len(i)], z[1 : len(i) + 1]
    return np.stack([x[i], x[i], y[i], (y[i + 1] - y[i]) / h[i] - h[i] * (2 * c + then) / 3, c, (then - c) / (3 * h[i])], 1)


def pieces_of(x: np.ndarray, y: np.ndarray, kind: str, bc: str = "not-a-knot") -> np.ndarray:
    """All pieces of a knot table in memory. Three knots make one parabola (but for other ends of a cubic), two a line."""
    n, t = len(x), np.arange(len(x))
    if n == 2 and (kind != "cubic" or bc != "clamped"):
        kind = "linear"
    elif n == 3 and kind == "cubic" and bc == "not-a-knot":
        kind = "quadratic"
    core, z = slice(0, n), None
    if kind != "linear":
        low, diagonal, high, r = _equations(kind, bc, t, x, y, n, core)
        z = _sweep(low, diagonal, high, r[:, None])[:, 0]
    return _pieces(kind, bc, t, x, y, n, core, z, 0.0, 0.0)


def pieces(knots: DataFrame, kind: str = "cubic", bc: str = "not-a-knot", block: int = BLOCK) -> DataFrame:
    """_block, lo, at, a, b, c, d of a spline through a knot table (x, y; different x without nulls) of any size.

    Knots are numbered along one range partitioning; runs of ``block`` (4 at least) of them, with three knots around, are groups of bounded size.
    """
    placed = global_index(knots, ["x"], "t")
    n = placed.count()
    if n < 4:
        raise ValueError("a spline in blocks needs four knots")
    blocks = max(1, n // block)
    of = lambda t: F.least(F.floor(t / block), F.lit(blocks - 1)).cast("int")
    around = [of(F.greatest(F.col("t") - 2, F.lit(0))), of(F.col("t")), of(F.least(F.col("t") + 1, F.lit(n - 1)))]
    grouped = placed.select("t", "x", "y", F.explode(F.array_distinct(F.array(*around))).alias("_block")).groupBy("_block")

    def own(frame: pd.DataFrame) -> tuple:
        frame = frame.sort_values("t")
        b = int(frame["_block"].iloc[0])
        t = frame["t"].to_numpy()
        start, end = b * block, n if b == blocks - 1 else (b + 1) * block
        return b, t, frame["x"].to_numpy(), frame["y"].to_numpy(), slice(*np.searchsorted(t, [start, end]))

    def solve(t, x, y, core):
        low, diagonal, high, r = _equations(kind, bc, t, x, y, n, core)
        sides = np.zeros((len(r), 3))
        sides[:, 0], sides[0, 1], sides[-1, 2] = r, low[0], high[-1]
        return _sweep(low, diagonal, high, sides)

    def reduce(frame: pd.DataFrame) -> pd.DataFrame:
        b, *rest = own(frame)
        z = solve(*rest)
        return pd.DataFrame({"_block": [b], "e": [[*z[0], *z[-1]]]})

    first, last = [], []
    if kind != "linear":
        ends = sorted(grouped.applyInPandas(reduce, "_block int, e array<double>").collect())  # six numbers a block
        first, last = _borders([(tuple(r.e[:3]), tuple(r.e[3:])) for r in ends])

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        b, t, x, y, core = own(frame)
        z, before, after = None, 0.0, 0.0
        if kind != "linear":
            before, after = last[b - 1] if b else 0.0, first[b + 1] if b + 1 < blocks else 0.0
            z = solve(t, x, y, core) @ np.array([1.0, -before, -after])
        out = pd.DataFrame(_pieces(kind, bc, t, x, y, n, core, z, before, after), columns=["lo", "at", "a", "b", "c", "d"])
        out.insert(0, "_block", b)
        return out

    return grouped.applyInPandas(fill, f"_block int, {_PIECE}")


def value_at(piece: Column, v: Column, derivative: int = 0) -> Column:
    """A piece's value, or its first to third derivative."""
    u, a, b, c, d = v - piece["at"], piece["a"], piece["b"], piece["c"], piece["d"]
    return [a + u * (b + u * (c + u * d)), b + u * (2 * c + 3 * u * d), 2 * c + 6 * u * d, 6 * d + 0 * u][derivative]


def evaluate(df: DataFrame, value: str, table: DataFrame, derivative: int = 0, name: str = "y", rows: int = ROWS) -> DataFrame:
    """Adds the spline of a table of ``pieces`` to rows, by blocks: a block of over ``rows`` rows meets its pieces in several tasks.

    A row takes the last piece that begins at or before it, the first one if none does; null where the value isn't a number.
    """
    from gramlake.operators.state import cut

    table = cut(table)
    starts = np.array([r.lo for r in table.groupBy("_block").agg(F.min("lo").alias("lo")).orderBy("_block").collect()])  # one number a block
    lead = table.orderBy("lo").first()
    v = F.col(value).cast("double")

    @F.pandas_udf("int")
    def block_of(x: pd.Series) -> pd.Series:
        x = x.to_numpy(float)
        return pd.Series(np.where(np.isnan(x), -1, np.maximum(np.searchsorted(starts, x, side="right") - 1, 0)).astype("int32"))

    hot = {r.b: -(-r.n // rows) for r in df.select(block_of(v).alias("b")).groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > rows).collect()}  # rows / ROWS numbers at most
    times = F.coalesce(F.create_map(*[F.lit(i) for pair in hot.items() for i in pair])[F.col("_block")], F.lit(1)) if hot else F.lit(1)
    placed = df.select(F.struct("*").alias("_row"), v.alias("_at"), block_of(v).alias("_block"))
    placed = placed.select("_row", "_at", "_block", F.pmod(F.spark_partition_id(), times).alias("_part"))
    kind = table.select(F.struct("at", "a", "b", "c", "d").alias("p")).schema["p"].dataType
    left = placed.select("_block", "_part", "_at", F.lit(1).alias("_r"), "_row", F.lit(None).cast(kind).alias("_piece"))
    right = table.select("_block", F.explode(F.sequence(F.lit(0), times - 1)).alias("_part"), F.col("lo").alias("_at"), F.lit(0).alias("_r"), F.lit(None).cast(placed.schema["_row"].dataType).alias("_row"), F.struct("at", "a", "b", "c", "d").alias("_piece"))
    piece = F.last("_piece", True).over(Window.partitionBy("_block", "_part").orderBy("_at", "_r"))
    found = left.union(right).withColumn("_piece", piece).where("_r = 1")
    first = F.struct(*[F.lit(float(lead[c])).alias(c) for c in ("at", "a", "b", "c", "d")])
    out = F.when(finite(F.col("_at")), value_at(F.coalesce("_piece", first), F.col("_at"), derivative))
    return found.select("_row.*", out.alias(name))
