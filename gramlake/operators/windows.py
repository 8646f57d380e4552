"""Lags, differences and time indices over an explicit order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _window(by: list[str], order: list[str]):
    if not by:
        raise ValueError("an order without a key puts all rows in one task; use global_index for one series")
    return Window.partitionBy(*by).orderBy(*order)


def lags(df: DataFrame, column: str, steps: list[int], by: list[str], order: list[str]) -> DataFrame:
    """Adds column_l<k>: the value k rows before (k > 0) or after (k < 0) within ``by``. One shuffle on ``by``."""
    w = _window(by, order)
    return df.withColumns({f"{column}_l{k}".replace("-", "f"): F.lag(column, k).over(w) if k >= 0 else F.lead(column, -k).over(w) for k in steps})


def difference(df: DataFrame, column: str, by: list[str], order: list[str], d: int = 1, seasonal: int = 0, period: int = 1) -> DataFrame:
    """``d`` first differences, then ``seasonal`` ones over ``period``; each series loses d + seasonal * period rows."""
    w = _window(by, order)
    out = df.withColumn("_t", F.row_number().over(w))
    out = out.withColumn(column, F.col(column).cast("double"))
    for step in [1] * d + [period] * seasonal:
        out = out.withColumn(column, F.col(column) - F.lag(column, step).over(w))
    return out.where(F.col("_t") > d + seasonal * period).drop("_t")


def time_index(df: DataFrame, by: list[str], order: list[str], name: str = "t") -> DataFrame:
    """0-based position within ``by``. One shuffle on ``by``."""
    return df.withColumn(name, F.row_number().over(_window(by, order)) - 1)


def global_index(df: DataFrame, order: list[str], name: str = "t") -> DataFrame:
    """0-based position of every row in one order over the whole table, without a single-task sort.

    Rows are range-partitioned and sorted; each partition's count (one number a partition) gives its
    offset. Two passes over the sorted rows.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    from gramlake.operators.state import cut

    placed = cut(placed)
    counts = placed.groupBy("_p").agg(F.count("*").alias("n"), F.min("_m").alias("m")).orderBy("_p").collect()
    total, rows = 0, []
    for r in counts:
        rows.append((r["_p"], total - r.m))
        total += r.n
    offsets = df.sparkSession.createDataFrame(rows, "_p int, _o long")
    return placed.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_m") + F.col("_o")).drop("_p", "_m", "_o")
