"""Cuts of lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, a folder of our own in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or tempfile.mkdtemp(prefix="gramlake-")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the cluster shares."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()


#: Rows of a partition below which it isn't worth dealing them to more tasks.
FEW_ROWS = 4096


def held(rows: DataFrame) -> DataFrame:
    """Cached rows of an iterative fit, on all cores: what a join or an aggregate left in fewer partitions is dealt anew, since kernels cost far more than the bytes by which Spark sizes partitions."""
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    n, parts = rows.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if parts >= cores or n <= FEW_ROWS * max(parts, 1):
        return rows
    dealt = rows.repartition(2 * cores).persist(StorageLevel.MEMORY_AND_DISK)
    dealt.count()
    rows.unpersist()
    return dealt
