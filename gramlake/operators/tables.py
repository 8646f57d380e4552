"""Work on result tables: ordering, multiple testing, samples, comparison of fits."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coef_table(table: DataFrame, order_by: str = "p", only_significant: float | None = None, only_nonzero: bool = False, top: int | None = None) -> DataFrame:
    """Rows of a coefficient table, filtered and ordered; the first ``top`` by one ordered limit."""
    if only_significant is not None:
        table = table.where(F.col("p") < only_significant)
    if only_nonzero:
        table = table.where("coef <> 0")
    table = table.orderBy(F.abs(order_by), "term")
    return table.limit(top) if top else table


def benjamini_hochberg(table: DataFrame, p: str, fdr: float = 0.05, by: list[str] = ()) -> DataFrame:
    """Adds bh_rank, bh_threshold (fdr * rank / m), bh_flag (p within its own threshold) and bh_reject (the step-up rule).

    Ranks of millions of tests come from counts of equal p-values, so that without ``by`` no task holds
    them all: distinct p-values in buckets of their value carry running counts. Equal p-values rank by the other columns, in
    the table's order, so that ranks don't depend on partitions.
    """
    known = table.where(F.col(p).isNotNull())
    others = [c for c, kind in table.dtypes if c != p and c not in by and "map<" not in kind and "variant" not in kind]
    if by:
        w = Window.partitionBy(*by)
        m = F.count("*").over(w)
        ranked = known.withColumn("bh_rank", F.row_number().over(w.orderBy(p, *others))).withColumn("bh_threshold", F.lit(fdr) * F.col("bh_rank") / m)
        ranked = ranked.withColumn("bh_flag", F.col(p) <= F.col("bh_threshold"))
        last = F.max(F.when(F.col("bh_flag"), F.col("bh_rank"))).over(w)
        return ranked.withColumn("bh_reject", F.coalesce(F.col("bh_rank") <= last, F.lit(False)))
    from gramlake.operators.windows import global_index

    m = known.count()
    ranked = global_index(known, [p, *others], "_t").withColumn("bh_rank", F.col("_t") + 1).drop("_t")
    ranked = ranked.withColumn("bh_threshold", F.lit(fdr) * F.col("bh_rank") / m).withColumn("bh_flag", F.col(p) <= F.col("bh_threshold"))
    last = ranked.where("bh_flag").agg(F.max("bh_rank")).first()[0] or 0
    return ranked.withColumn("bh_reject", F.col("bh_rank") <= last)


def sample_rows(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """The n rows of least hash of their key: a repeatable sample whatever the partitions."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def compare_fits(fits: dict[str, DataFrame], value: str = "coef") -> DataFrame:
    """One row for each term, one column for each fit."""
    rows = functools.reduce(DataFrame.unionByName, [t.select("term", F.col(value).alias("v"), F.lit(n).alias("fit")) for n, t in fits.items()])
    return rows.groupBy("term").pivot("fit", list(fits)).agg(F.first("v"))


def stack_equations(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several equations under each other, their other columns prefixed with the equation's name."""
    out = None
    for name, t in tables.items():
        rows = t.select(*keys, F.lit(name).alias("equation"), *[F.col(c).alias(f"{name}_{c}") for c in t.columns if c not in keys])
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
