"""Cutting lineage through reliable checkpoints, and folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only in a local session that sets none (tests).

    On a cluster each machine has its own temporary folder, so there a session without one is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """A new folder for tables, beside the checkpoints."""
    return f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
