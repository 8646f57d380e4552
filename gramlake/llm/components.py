"""Connected components of a large edge table, by rounds of star operations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlake.llm.common import cut

#: Rounds after which something must be wrong: the number needed grows with the logarithm of a component's size.
MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least reachable node) for every node of ``edges`` (columns a and b, longs).

    Each round links every node's larger neighbours to its least one, then its smaller ones to their
    least; both are a map-side combined minimum and a join on one node, which a skew join can split.
    Rounds end when all edges are stars: no node has two lesser ones, or a lesser and a greater one. Nulls and
    self-loops are ignored; repeated edges count once; an empty table gives no rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    for _ in range(MOST_ROUNDS):
        ends = now.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("lo", F.lit(0), F.lit(1)))
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]:
            break
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        small_least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(small_least, "hi")
        small = joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(small_least.select("hi", F.col("m").alias("lo")))
        now = cut(small.distinct())
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(now.select("lo", "lo").distinct())


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes over the links left-right."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        differ = a != b
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        if not len(left):
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:  # roots of roots
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label
