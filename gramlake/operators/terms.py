"""Designs: typed terms over DataFrame columns, prepared once into narrow columns and expanded in numpy.

A term is a list of numeric Column expressions times at most one categorical. ``Design.fit`` finds what
must be remembered (levels, means, knots, the rows that are valid); ``Plan.rows`` is then a plain
projection with one double for each numeric column and one level index for each categorical: dummies
are never made into Spark columns, only into blocks of a kernel's matrix.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categorical levels up to which level indices come from a broadcast table; beyond it from a shuffled join.
BROADCAST_LEVELS = 200_000
#: Levels of one categorical term up to which its dummies are columns of a kernel's block; with more, ``linear.level_ols`` and
#: absorbed effects take them, which hold no level on the driver.
MOST_LEVELS = 5_000


@dataclass
class Term:
    """Names and expressions of numeric columns, and the categorical columns that cross them (none: no dummies).

    An expression is SQL text, so that a term can be written before there is a session; a fitted spline's
    is a Column.
    """

    names: list[str]
    columns: list[str | Column]
    by: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()
    fit: object = None  # DataFrame -> Term, for terms that remember

    def __mul__(self, other: "Term") -> "Term":
        """The product of two terms."""
        pairs = list(itertools.product(range(len(self.names)), range(len(other.names))))
        join = lambda a, b: b if a == "1" else a if b == "1" else f"{a}:{b}"
        return Term([join(self.names[i], other.names[j]) for i, j in pairs], [_times(self.columns[i], other.columns[j]) for i, j in pairs], (*self.by, *(c for c in other.by if c not in self.by)), (*self.inputs, *other.inputs))


def of(c: str | Column) -> Column:
    return F.expr(c) if isinstance(c, str) else c


def _times(a, b):
    if a == "1D" or b == "1D":
        return b if a == "1D" else a
    return f"({a}) * ({b})" if isinstance(a, str) and isinstance(b, str) else of(a) * of(b)


def _double(column: str) -> str:
    return f"cast(`{column}` as double)"


def num(column: str) -> Term:
    return Term([column], [_double(column)], inputs=(column,))


def expr(sql: str, name: str | None = None) -> Term:
    """Any numeric SQL expression of a row."""
    return Term([name or sql], [f"cast({sql} as double)"])


def poly(column: str, degrees: int | list[int], constant: bool = False) -> Term:
    """Powers of a column: 1..d, or those listed; with the constant only if asked."""
    powers = [*range(0 if constant else 1, degrees + 1)] if isinstance(degrees, int) else list(degrees)
    return Term([f"{column}^{d}" for d in powers], [f"pow({_double(column)}, {d})" if d != 1 else _double(column) for d in powers], inputs=(column,))


def monomials(a: str, b: str, degree: int) -> Term:
    """All products of powers of two columns up to a total degree, without the constant."""
    powers = [(i, d - i) for d in range(1, degree + 1) for i in range(d, -1, -1)]
    return Term([f"{a}^{i}*{b}^{j}" for i, j in powers], [f"pow({_double(a)}, {i}) * pow({_double(b)}, {j})" for i, j in powers], inputs=(a, b))


def cheb(column: str, degree: int) -> Term:
    """Chebyshev polynomials T1..Td of the column scaled to [-1, 1] by the fitted least and largest value."""

    def fit(df: DataFrame) -> Term:
        low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
        z = f"((2 * {_double(column)} - {low + high!r}D) / {(high - low) or 1.0!r}D)"
        out = ["1D", z]
        for _ in range(2, degree + 1):
            out.append(f"(2 * {z} * {out[-1]} - {out[-2]})")
        return Term([f"T{i}({column})" for i in range(1, degree + 1)], out[1 : degree + 1], inputs=(column,))

    return Term([], [], inputs=(column,), fit=fit)


def standardize(column: str, weight: str | None = None, scale: bool = True) -> Term:
    """The column less its (weighted) mean, over its (weighted) population deviation if ``scale``."""

    def fit(df: DataFrame) -> Term:
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        x = F.col(column).cast("double")
        mean = df.agg((F.sum(w * x) / F.sum(w)).alias("m")).first().m
        centred = f"({_double(column)} - {float(mean)!r}D)"
        if not scale:
            return Term([f"center({column})"], [centred], inputs=(column,))
        sd = df.agg(F.sqrt(F.sum(w * of(centred) * of(centred)) / F.sum(w)).alias("s")).first().s
        return Term([f"standardize({column})"], [f"({centred} / {sd or 1.0!r}D)"], inputs=(column,))

    return Term([], [], inputs=(column,), fit=fit)


def center(column: str, weight: str | None = None) -> Term:
    return standardize(column, weight, scale=False)


def cat(*columns: str) -> Term:
    """Dummies of the observed levels, or of the observed combinations of several columns."""
    return Term(["1"], ["1D"], tuple(columns))


def trend(index: str, powers: list[int]) -> Term:
    """Powers of a 0-based time index column."""
    return Term([f"t^{p}" for p in powers], [f"pow({_double(index)}, {p})" for p in powers], inputs=(index,))


def seasonal(index: str, periods: list[int]) -> Term:
    """Dummies of the index modulo each period but the first phase; a period contained in a larger one is dropped."""
    keep = [p for p in periods if not any(q != p and q % p == 0 for q in periods)]
    phases = [(p, k) for p in keep for k in range(1, p)]
    return Term([f"s{p}[{k}]" for p, k in phases], [f"cast(`{index}` % {p} = {k} as double)" for p, k in phases], inputs=(index,))


def _basis(x: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """B-spline basis by the recurrence, x clipped into the knots' range."""
    x = np.clip(x, knots[0], knots[-1])
    out = ((knots[:-1] <= x[:, None]) & (x[:, None] < knots[1:])).astype(float)
    last = np.flatnonzero(knots[:-1] < knots[1:])[-1]
    out[x >= knots[-1], last] = 1.0
    for d in range(1, degree + 1):
        n = len(knots) - d - 1
        left, right = knots[d : d + n] - knots[:n], knots[d + 1 : d + 1 + n] - knots[1 : 1 + n]
        a = np.divide(x[:, None] - knots[:n], left, out=np.zeros((len(x), n)), where=left > 0)
        b = np.divide(knots[d + 1 : d + 1 + n] - x[:, None], right, out=np.zeros((len(x), n)), where=right > 0)
        out = a * out[:, :n] + b * out[:, 1 : n + 1]
    return out


def bs(column: str, df: int = 6, degree: int = 3, include_intercept: bool = False) -> Term:
    """B-spline basis with knots at equally spaced quantiles, remembered from the fit."""

    def fit(frame: DataFrame) -> Term:
        inner = df + (not include_intercept) - degree - 1
        shares = [0.0, *[(i + 1) / (inner + 1) for i in range(inner)], 1.0]
        from gramlake.operators.aggregates import quantiles

        q = quantiles(frame, F.col(column), shares).first().q
        knots = np.array([q[0] - 1e-6] * (degree + 1) + q[1:-1] + [q[-1] + 1e-6] * (degree + 1))

        @F.pandas_udf("array<double>")
        def basis(x):
            import pandas as pd

            b = _basis(x.to_numpy(float), knots, degree)
            return pd.Series(list(b if include_intercept else b[:, 1:]))

        whole = basis(F.col(column).cast("double"))
        return Term([f"bs({column})[{i}]" for i in range(df)], [whole[i] for i in range(df)], inputs=(column,))

    return Term([], [], inputs=(column,), fit=fit)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


@dataclass
class Design:
    """What to fit: outcomes, terms, and optionally instruments, weights and an intercept."""

    y: list[str]
    x: list[Term]
    instruments: list[Term] = field(default_factory=list)
    weights: str | None = None
    intercept: bool = True

    def fit(self, df: DataFrame) -> "Plan":
        """Remember levels, means and knots over the valid rows. A distinct for each categorical; an aggregate for each stateful term."""
        df = df.where(self.valid(df))
        blocks = {}
        for part, terms in (("x", self.x), ("z", self.instruments)):
            done = [t.fit(df) if t.fit else t for t in terms]
            levels, full = [], self.intercept
            for t in done:
                if t.by:
                    rows = df.select(*[F.col(c).cast("string").alias(c) for c in t.by]).distinct().limit(MOST_LEVELS + 1).collect()
                    if len(rows) > MOST_LEVELS:
                        raise ValueError(f"more than {MOST_LEVELS} levels of {', '.join(t.by)}: use level_ols or absorb_ols")
                    found = sorted(tuple(r) for r in rows)
                    levels.append(found)
                else:
                    levels.append(None)
            blocks[part] = (done, levels, full)
        return Plan(self, blocks)

    def valid(self, df: DataFrame) -> Column:
        """Rows whose every referenced value is usable: finite numbers, categories that aren't null, weights over 0."""
        ok = F.lit(True)
        for name in self.y:
            ok = ok & finite(F.expr(name).cast("double"))
        for t in [*self.x, *self.instruments]:
            for c in t.inputs if t.fit else ():
                ok = ok & finite(F.col(c).cast("double"))
            for c in t.columns:
                if c != "1D":
                    ok = ok & finite(of(c))
            for c in t.by:
                ok = ok & F.col(c).isNotNull()
        if self.weights:
            w = F.col(self.weights).cast("double")
            ok = ok & finite(w) & (w > 0)
        return ok


class Plan:
    """A fitted design: names of the matrix columns, the projection, and the matrix of a block of rows."""

    def __init__(self, design: Design, blocks: dict):
        self.design, self.blocks = design, blocks
        self.shift: dict[str, np.ndarray] = {}
        self.names = self._names("x")
        self.z_names = self._names("z") if design.instruments else []

    def __getstate__(self):
        """What a kernel on a worker needs: names and levels, no expressions."""
        d = self.design
        bare = Design(list(d.y), [], instruments=[Term([], [])] if d.instruments else [], weights=d.weights, intercept=d.intercept)
        blocks = {p: ([Term(t.names, [], t.by) for t in done], levels, full) for p, (done, levels, full) in self.blocks.items()}
        return {"design": bare, "blocks": blocks, "names": self.names, "z_names": self.z_names, "shift": self.shift}

    def shifted(self, x: np.ndarray, z: np.ndarray | None = None) -> "Plan":
        """The same plan with constants taken off the columns of its matrices."""
        out = Plan.__new__(Plan)
        out.__dict__.update(self.__dict__, shift={"x": x} | ({} if z is None else {"z": z}))
        return out

    def numeric(self, part: str = "x") -> np.ndarray:
        """Which columns come from numbers alone: neither the intercept nor a dummy's."""
        out = [False] if self.design.intercept else []
        for t, found, drop in self._parts(part):
            out += [True] * len(t.names) if found is None else [False] * (len(t.names) * (len(found) - drop))
        return np.array(out, bool)

    def _parts(self, part: str):
        """Each term with its levels and how many of them are dropped for the constant."""
        done, levels, full = self.blocks[part]
        for t, found in zip(done, levels, strict=True):
            drop = 0
            if found is not None and t.names == ["1"]:
                drop, full = int(full), True  # the first full set of dummies holds the constant
            yield t, found, drop

    def _names(self, part: str) -> list[str]:
        out = ["Intercept"] if self.design.intercept else []
        for t, found, drop in self._parts(part):
            if found is None:
                out += t.names
            else:
                tags = [":".join(f"C({c})[{v}]" for c, v in zip(t.by, level, strict=True)) for level in found[drop:]]
                out += [tag if n == "1" else f"{n}:{tag}" for n in t.names for tag in tags]
        return out

    def rows(self, df: DataFrame, keep: list[Column | str] = (), valid_only: bool = True) -> DataFrame:
        """y0.., x0.., z0.. doubles, level indices, w, and the columns to keep. A filter, a projection, and a join for each categorical."""
        d = self.design
        if valid_only:
            df = df.where(d.valid(df))
        lookups, indexed = {}, {}
        for part in ("x", "z"):
            if part == "z" and not d.instruments:
                continue
            for i, (t, found, _) in enumerate(self._parts(part)):
                if found is None:
                    continue
                if t.by not in lookups:
                    name = f"_level{len(lookups)}"
                    lookups[t.by] = (name, found)
                indexed[part, i] = lookups[t.by][0]
        spark = df.sparkSession
        for by, (name, found) in lookups.items():
            if len(found) <= 500:
                flat = [x for n, level in enumerate(found) for x in (F.lit("\x1f".join(level)), F.lit(n))]
                key = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in by])
                df = df.withColumn(name, F.coalesce(F.create_map(*flat)[key], F.lit(-1)) if flat else F.lit(-1))
            else:
                table = spark.createDataFrame([(*level, n) for n, level in enumerate(found)], ", ".join([f"`{name}_{j}` string" for j in range(len(by))] + [f"`{name}` int"]))
                on = [F.col(c).cast("string") == F.col(f"{name}_{j}") for j, c in enumerate(by)]
                df = df.join(F.broadcast(table) if len(found) <= BROADCAST_LEVELS else table, on, "left").withColumn(name, F.coalesce(name, F.lit(-1)))
        out = [F.expr(y).cast("double").alias(f"y{i}") for i, y in enumerate(d.y)]
        for part in ("x", "z"):
            if part == "z" and not d.instruments:
                continue
            for i, (t, found, _) in enumerate(self._parts(part)):
                if found is None or t.names != ["1"]:
                    out += [of(c).cast("double").alias(f"{part}{i}_{j}") for j, c in enumerate(t.columns)]
                if found is not None:
                    out.append(F.col(indexed[part, i]).alias(f"{part}{i}_l"))
        out.append(F.col(d.weights).cast("double").alias("w") if d.weights else F.lit(1.0).alias("w"))
        return df.select(*out, *keep)

    def matrix(self, cols: dict[str, np.ndarray], part: str = "x") -> np.ndarray:
        """The dense block of some rows; a level that the fit hasn't seen has no dummy."""
        n = len(cols["w"])
        out = [np.ones((n, 1))] if self.design.intercept else []
        for i, (t, found, drop) in enumerate(self._parts(part)):
            values = None if found is not None and t.names == ["1"] else np.stack([cols[f"{part}{i}_{j}"] for j in range(len(t.names))], 1)
            if found is None:
                out.append(values)
                continue
            level = cols[f"{part}{i}_l"].astype(int) - drop
            dummies = np.zeros((n, len(found) - drop))
            seen = np.flatnonzero(level >= 0)
            dummies[seen, level[seen]] = 1.0
            out += [dummies] if values is None else [dummies * values[:, [j]] for j in range(values.shape[1])]
        whole = np.concatenate(out, axis=1) if out else np.zeros((n, 0))
        return whole - self.shift[part] if part in self.shift else whole

    def plain(self, part: str = "x") -> list[Column] | None:
        """The matrix columns as Columns of the prepared rows; None where a term has dummies."""
        out = [F.lit(1.0)] if self.design.intercept else []
        for i, (t, found, _) in enumerate(self._parts(part)):
            if found is not None:
                return None
            out += [F.col(f"{part}{i}_{j}") for j in range(len(t.names))]
        return [c - F.lit(float(v)) if v else c for c, v in zip(out, self.shift[part], strict=True)] if part in self.shift else out

    def outcomes(self, cols: dict[str, np.ndarray]) -> np.ndarray:
        return np.stack([cols[f"y{i}"] for i in range(len(self.design.y))], 1) if self.design.y else np.zeros((len(cols["w"]), 0))

    def predictions(self, df: DataFrame, beta: np.ndarray, name: str = "fitted", link=None) -> DataFrame:
        """The input with X beta (through ``link``) as a column: numeric terms as expressions, dummies by their coefficient."""
        return _predict(self, df, np.asarray(beta, float), name, link)


def _predict(plan: Plan, df: DataFrame, beta: np.ndarray, name: str, link) -> DataFrame:
    at, total = 0, F.lit(0.0)
    if plan.design.intercept:
        total, at = F.lit(float(beta[0])), 1
    for t, found, drop in plan._parts("x"):
        if found is None:
            for c in t.columns:
                total = total + of(c) * F.lit(float(beta[at]))
                at += 1
            continue
        key = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in t.by])
        for c in t.columns:
            flat = [x for n, level in enumerate(found) for x in (F.lit("\x1f".join(level)), F.lit(0.0 if n < drop else float(beta[at + n - drop])))]
            total = total + of(c) * F.create_map(*flat)[key]  # an unseen level has no prediction
            at += len(found) - drop
    return df.withColumn(name, link(total) if link else total)


def null_report(df: DataFrame, design: Design) -> DataFrame:
    """Rows, and invalid rows of y, x, instruments, weights and of any of them. One aggregate."""

    def bad(d: Design) -> Column:
        return F.sum((~F.coalesce(d.valid(df), F.lit(False))).cast("long"))

    parts = {"y": Design(design.y, []), "x": Design([], design.x), "instruments": Design([], design.instruments), "weights": Design([], [], weights=design.weights), "any": design}
    return df.agg(F.count("*").alias("n_rows"), *[F.coalesce(bad(d), F.lit(0)).alias(f"invalid_{k}") for k, d in parts.items()])
