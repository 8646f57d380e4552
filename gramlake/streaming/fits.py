"""Fits over streams: running sums by micro-batch, and one fit for each event-time window."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.operators.linear import solve_scaled


def sums(df: DataFrame, y: str, x: list[str]) -> list:
    """Aggregates n and the sums of products of (1, x, y), in one order."""
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in x], F.col(y).cast("double")]
    return [F.sum(columns[i] * columns[j]).alias(f"s{i}_{j}") for i in range(len(columns)) for j in range(i, len(columns))]


def solve(row: dict, k: int) -> np.ndarray:
    """Coefficients (Intercept, x) from one row of sums."""
    m = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k + 1)] for i in range(k + 1)])
    return solve_scaled(m[:k, :k], m[:k, k])[0]


def streaming_gram(stream: DataFrame, y: str, x: list[str], state: str, checkpoint: str):
    """A query that writes each micro-batch's sums under its batch id, so that a repeated batch replaces itself.

    The state is one row a batch; ``running_fit`` adds them up. Nulls in any column leave a row out.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        one = batch.na.drop(subset=[y, *x]).agg(*sums(batch, y, x)).where("s0_0 is not null")
        one.coalesce(1).write.mode("overwrite").parquet(os.path.join(state, f"batch={batch_id}"))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_fit(spark, state: str, k: int) -> np.ndarray:
    """Coefficients over all batches so far (k columns with the intercept)."""
    t = spark.read.parquet(state)
    names = [c for c in t.columns if c.startswith("s")]
    return solve(t.agg(*[F.sum(c).alias(c) for c in names]).first().asDict(), k)


def windowed_fit(stream: DataFrame, ts: str, y: str, x: str, key: list[str], width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """window_start, key, n, slope, intercept for each event-time window: sums by window, then two divisions.

    Works on a stream (append mode emits a window once the watermark passes it; later rows are dropped) and
    on a table alike. Rows with a null x or y are left out.
    """
    d = stream.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    if stream.isStreaming:
        d = d.withWatermark(ts, delay)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    g = d.groupBy(F.window(ts, width, slide or width).alias("w"), *key).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"))
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(F.abs(det) > 1e-9 * F.col("n") * F.col("sxx"), (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det)
    return g.select(F.col("w.start").alias("window_start"), *key, "n", slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("intercept"))
