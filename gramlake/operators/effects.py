"""Effects of a column on a fitted mean, for each row or on average, with errors by the delta method: expressions of the rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlake.operators.linear import Fit

#: Step in a column and in a parameter, relative to the parameter; differences are central.
STEP = 1e-3


def _with(fit: Fit, params: np.ndarray) -> Fit:
    out = replace(fit, params=params)
    for name in ("link", "family", "model", "plan2", "sizes"):
        if hasattr(fit, name):
            setattr(out, name, getattr(fit, name))
    return out


def _changes(fit: Fit, df: DataFrame, column: str, predict: Callable, secant: bool, step: float) -> DataFrame:
    """Rows with _e, the change of the predicted mean for a unit of the column, and _j0, _j1, ..., how it moves with each parameter."""
    at = (F.lit(0.0), F.lit(1.0), 1.0) if secant else (F.col("_was") - step, F.col("_was") + step, 2 * step)
    kept = [c for c in df.columns if c != column]
    df = df.withColumn("_was", F.col(column).cast("double"))
    ways = [(fit.params, "_e")]
    moves = STEP * np.maximum(1.0, np.abs(fit.params))
    for i, h in enumerate(moves):
        ways += [(fit.params + sign * h * np.eye(len(moves))[i], f"_{name}{i}") for sign, name in ((1, "u"), (-1, "d"))]
    for params, name in ways:
        moved = _with(fit, params)
        low = predict(moved, df.withColumn(column, at[0]), "_low")
        both = predict(moved, low.withColumn(column, at[1]), "_high")
        df = both.withColumn(name, (F.col("_high") - F.col("_low")) / at[2]).drop("_low", "_high")
    jacobian = [((F.col(f"_u{i}") - F.col(f"_d{i}")) / (2 * float(h))).alias(f"_j{i}") for i, h in enumerate(moves)]
    return df.select(F.col("_was").alias(column), *kept, "_e", *jacobian)


def row_effects(fit: Fit, df: DataFrame, column: str, predict: Callable, secant: bool = False, step: float = STEP) -> DataFrame:
    """The rows with ``effect`` of a numeric column on the predicted mean, and its ``std_err``.

    ``predict(fit, df, name)`` adds the mean, as ``irls.predict`` and ``mle.predict_mean`` do; the column may enter any term. ``secant``: the
    change from 0 to 1, for dummies. All is one projection: no pass, no shuffle. A null column has null effects.
    """
    k = len(fit.params)
    out = _changes(fit, df, column, predict, secant, step)
    total: Column = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            total = total + F.col(f"_j{i}") * F.col(f"_j{j}") * F.lit(float(fit.cov[i, j]))
    return out.withColumns({"effect": F.col("_e"), "std_err": F.sqrt(F.greatest(total, F.lit(0.0)))}).drop("_e", *[f"_j{i}" for i in range(k)])


def average_effects(fit: Fit, df: DataFrame, columns: list[str], predict: Callable, secant: tuple[str, ...] = (), step: float = STEP, weight: str | None = None) -> dict[str, tuple[float, float]]:
    """Each column's effect averaged over the rows (with weights), and its error; one aggregate a column. NaN without rows."""
    out = {}
    for column in columns:
        rows = _changes(fit, df, column, predict, column in secant, step).where("_e is not null")
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        mean = lambda c: F.sum(F.col(c) * w) / F.sum(w)  # noqa: E731, B023
        r = rows.agg(mean("_e").alias("e"), *[mean(f"_j{i}").alias(f"j{i}") for i in range(len(fit.params))]).first()
        j = np.array([math.nan if r[f"j{i}"] is None else r[f"j{i}"] for i in range(len(fit.params))])
        out[column] = (math.nan if r.e is None else float(r.e), float(np.sqrt(j @ fit.cov @ j)))
    return out
