"""Feature matrices by key, stored in blocks of columns, so that reading the first n numbers of each row reads no more.

A store is a Parquet table: ``key``, what describes it, ``n_rows``, ``n_columns`` and a column per block
(``c0000``: columns 0 to BLOCK - 1 of all rows, one row after another). Spark's own commit makes it whole:
a task that fails and is tried again leaves nothing behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 64


def _block(k: int) -> str:
    return f"c{k:04d}"


def written(df: DataFrame, path: str, key: str, matrix: str, columns: int, block: int = BLOCK) -> None:
    """Write (key, others, ``matrix`` array<array<number>>) of up to ``columns`` columns; a row that is wider or not like its first raises."""
    width = F.coalesce(F.size(F.get(matrix, F.lit(0))), F.lit(0))
    even = F.forall(matrix, lambda r: F.size(r) == width) & (width <= columns)
    checked = F.when(even, F.col(matrix)).otherwise(F.raise_error(F.concat(F.lit("uneven or too wide a matrix of "), F.col(key).cast("string"))))
    parts = [F.flatten(F.transform("_m", lambda r: F.slice(r, k * block + 1, block).cast("array<float>"))).alias(_block(k)) for k in range(-(-columns // block))]
    others = [c for c in df.columns if c not in (key, matrix)]
    made = df.select(F.col(key).cast("string").alias("key"), *others, checked.alias("_m"), width.alias("n_columns"))
    made.select("key", *others, F.size("_m").alias("n_rows"), "n_columns", F.lit(block).alias("block"), *parts).write.parquet(path)


def read(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """(key, others, ``matrix`` array<array<float>>): the first ``first`` columns, or all. Blocks beyond those are not read."""
    table = spark.read.parquet(path)
    blocks = sorted(c for c in table.columns if len(c) == 5 and c[0] == "c" and c[1:].isdigit())
    one = table.select("block").first()
    size = one[0] if one else BLOCK
    kept = blocks if first is None else blocks[: -(-first // size)]
    wide = F.col("n_columns") if first is None else F.least(F.col("n_columns"), F.lit(first))

    def of_row(r: Column) -> Column:
        parts = []
        for k, c in enumerate(kept):
            held = F.greatest(F.lit(0), F.least(F.col("n_columns") - k * size, F.lit(size)))
            parts.append(F.slice(F.col(c), r * held + 1, held))
        return F.slice(F.concat(*parts), F.lit(1), wide) if parts else F.array().cast("array<float>")

    rows = F.when(F.col("n_rows") > 0, F.transform(F.sequence(F.lit(0), F.col("n_rows") - 1), of_row)).otherwise(F.array().cast("array<array<float>>"))
    others = [c for c in table.columns if c not in ("key", "n_rows", "n_columns", "block", *blocks)]
    return table.select("key", *others, rows.alias("matrix"))
