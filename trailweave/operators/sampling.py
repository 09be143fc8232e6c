"""Sampling, mixing, batching and splitting, all driven by hashes of keys and a seed.

A hash takes the place of a random generator, so a task that is run again draws the same, and the
result does not depend on how rows are partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Hex digits of an MD5 that make a number in [0, 1): 52 bits, exact in a double.
DIGITS = 13


def unit(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) from keys and a seed."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(k if isinstance(k, Column) else F.col(k).cast("string") for k in keys)))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def task_of(weights: dict[str, float], draw: Column) -> Column:
    """The task that a draw in [0, 1) falls to, by cumulative weights in the given order."""
    total, edge, chosen = sum(weights.values()), 0.0, None
    names = list(weights)
    for name in names[:-1]:
        edge += weights[name] / total
        chosen = F.when(draw < edge, name) if chosen is None else chosen.when(draw < edge, name)
    return F.lit(names[-1]) if chosen is None else chosen.otherwise(names[-1])


def drawn_tasks(spark: SparkSession, steps: int, weights: dict[str, float], seed: int) -> DataFrame:
    """(step, task): one weighted draw with replacement per step."""
    return spark.range(steps).select(F.col("id").alias("step"), task_of(weights, unit(seed, F.col("id").cast("string"))).alias("task"))


def scheduled(draws: DataFrame, sizes: DataFrame, batch: int) -> DataFrame:
    """(step, task, epoch, batch_no): which batch of its source each step takes; used-up sources begin again.

    sizes: (task, n). Steps of a task are numbered inside the task.
    """
    k = F.row_number().over(Window.partitionBy("task").orderBy("step")) - 1
    per_epoch = F.ceil(F.col("n") / batch)
    d = draws.withColumn("_k", k).join(sizes, "task")
    return d.select("step", "task", F.floor(F.col("_k") / per_epoch).alias("epoch"), (F.col("_k") % per_epoch).alias("batch_no"))


def sampled(values: str, most: int, seed: int, key: str) -> Column:
    """At most ``most`` elements without replacement, in the order of their hashes; strings or numbers."""
    hashed = F.array_sort(F.transform(values, lambda v: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), v.cast("string"))).alias("h"), v.alias("v"))))
    return F.slice(F.transform(hashed, lambda x: x["v"]), 1, most)


def gumbel_choice(scores: str, seed: int, *keys: str) -> Column:
    """An index drawn by the softmax of scores: the greatest score after Gumbel noise."""
    noisy = F.transform(scores, lambda s, k: F.struct((s - F.log(-F.log(F.greatest(unit(seed, *keys, k.cast("string")), F.lit(1e-12))))).alias("g"), (-k).alias("k")))
    return -F.array_max(noisy)["k"]


#: Ranges of hashes in which ``shuffled`` numbers rows, each on its own.
RANGES = 4096


def shuffled(df: DataFrame, seed: int, *keys: str, ranges: int = RANGES) -> DataFrame:
    """All rows with their ``place`` from 0 in the order of their keys' hashes.

    Rows fall into ranges of the hash, which are even, and are numbered inside a range; only the counts of
    the ranges are ordered as a whole, so no task sorts all rows.
    """
    u = unit(seed, *keys)
    rows = df.withColumn("_u", u).withColumn("_range", F.floor(F.col("_u") * ranges))
    before = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # ``ranges`` rows
    inside = F.row_number().over(Window.partitionBy("_range").orderBy("_u", *keys)) - 1
    return rows.withColumn("_k", inside).join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + F.col("_k")).drop("_u", "_range", "_k", "_before")


def of_rank(df: DataFrame, place: str, rank: int, ranks: int) -> DataFrame:
    """Every ``ranks``-th row by a numbered column."""
    return df.where(F.col(place) % ranks == rank)


def contiguous_part(place: Column, n: int | Column, workers: int) -> Column:
    """The worker of a row's place: equal runs, the last worker taking what is left over."""
    share = F.greatest(F.floor(F.lit(n) / workers) if isinstance(n, int) else F.floor(n / workers), F.lit(1))
    return F.least(F.floor(place / share), F.lit(workers - 1)).cast("int")


def batches(df: DataFrame, place: str, size: int, columns: list[str]) -> DataFrame:
    """(batch, batch_size, columns as arrays in order): rows collated ``size`` at a time by a numbered column."""
    r = df.withColumn("batch", F.floor(F.col(place) / size))
    g = r.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(place, *columns))).alias("r"))
    return g.select("batch", F.size("r").alias("batch_size"), *(F.col("r")[c].alias(c) for c in columns))
