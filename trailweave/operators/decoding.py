"""Decoding that may only say what a vocabulary of token lists allows, a step for all rows at once.

A step joins every unfinished list with what may follow it (``prefix_table``), scores those tokens alone
(any other has a score of minus infinity, so it is never made), and keeps the best lists of each row.
A list that cannot go on is followed by the end, and by nothing else. One beam is greedy decoding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailweave.sources.durable import durable


def followers(table: DataFrame) -> DataFrame:
    """(prefix, may array) of (prefix, next): one row a prefix, so that a join by it adds no rows before they are needed."""
    return table.groupBy("prefix").agg(F.array_sort(F.collect_set("next")).alias("may"))


def decoded(rows: DataFrame, table: DataFrame, scored: Callable[[DataFrame], DataFrame], eos: object, beams: int = 1, most_tokens: int = 50, cut: int = 4) -> DataFrame:
    """(the columns of rows, rank, tokens, total, ended): the best ``beams`` token lists of every row, ties by tokens.

    ``rows`` has a unique ``id``. ``scored`` adds ``score`` to (the columns of rows, step, tokens, token), from an
    expression, a join with a table or a model. Lists end with the end's score; after ``most_tokens`` they stay as they are. A
    checkpoint cuts the plan every ``cut`` steps. Without any allowed list all rows get an empty one.
    """
    own = rows.columns
    kind = table.schema["prefix"].dataType
    may = followers(table)
    deepest = table.agg(F.max(F.size("prefix"))).first()[0]
    none = F.array().cast(kind)
    state = rows.select(*own, none.alias("tokens"), F.lit(0.0).alias("total"), F.lit(False).alias("ended"))
    best = Window.partitionBy("id").orderBy(F.col("total").desc(), "tokens")
    for step in range(0 if deepest is None else min(deepest + 1, most_tokens)):
        key = F.when(~F.col("ended"), F.col("tokens"))  # an ended list meets nothing and stays
        met = state.withColumn("_key", key).join(may.withColumnRenamed("prefix", "_key"), "_key", "left")
        each = met.select(*own, "tokens", "total", "ended", F.lit(step).alias("step"), F.explode_outer("may").alias("token"))
        value = scored(each)
        ends = F.col("token") == F.lit(eos)
        state = value.select(
            *own, F.when(F.col("token").isNull() | ends, F.col("tokens")).otherwise(F.array_append("tokens", F.col("token"))).alias("tokens"),
            F.when(F.col("token").isNull(), F.col("total")).otherwise(F.col("total") + F.col("score")).alias("total"), (F.col("token").isNull() | ends).alias("ended"),
        )
        state = state.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= beams).drop("rank")
        if step % cut == cut - 1:
            state = durable(state)
    return state.select(*own, F.row_number().over(best).alias("rank"), "tokens", "total", "ended")
