"""Access to the benchmark tables of a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``, read by Spark (any Hadoop file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
