"""Dealing rows to tasks by the work they make, not by their bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tasks that a core gets at least.
TASKS_OF_A_CORE = 8


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` to a stated number of tasks.

    Adaptive execution puts small partitions together by their bytes. Where a short row becomes a thousand
    others, or a search, a few tasks would then do everything and spill; a stated number is left alone.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_OF_A_CORE * spark.sparkContext.defaultParallelism)
    return rows.repartition(n, *keys)
