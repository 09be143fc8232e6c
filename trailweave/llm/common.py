"""What several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.sources.durable import durable, shared_folder

__all__ = ["WHITE", "documents", "dropped", "durable", "shared_folder", "tokenizer_path", "whole_text"]

#: Space and the five ASCII controls \t \n \v \f \r.
WHITE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A table of the folder, read by Spark alone (the path may be any Hadoop file system)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more, on whatever file system it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def whole_text(col: str | Column) -> Column:
    """The text, an absent one being empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the driver reads it and sends its content to the tasks."""
    import public_tokenizers

    return public_tokenizers.path(name)
