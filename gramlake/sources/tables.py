"""Sources and sinks: tables with a declared schema, and tidy results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A table from parquet, orc, csv or json; csv and json take a declared schema, never an inferred one."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError("csv and json need a schema: inferring one reads the data twice")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.csv(path, header=True) if kind == "csv" else reader.format(kind).load(path)
    return df.select(*columns) if columns else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tidy results as parquet."""
    df.write.mode(mode).parquet(path)
