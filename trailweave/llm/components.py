"""Connected components of a link table, by alternating large and small stars.

Each round is two aggregations and joins over links, cut by a reliable checkpoint; nothing but two
numbers (the count of links and a sum of their hashes) reaches the driver. The minimum of a node's
neighbours is aggregated before it is joined back, so a node with very many links is one row on one
side of the join, and adaptive execution splits the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import durable


def _large_star(links: DataFrame) -> DataFrame:
    """(u, v) with u > v -> every larger neighbour of a node linked to the node's least neighbour."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    joined = both.join(least, both["u"] == least["n"]).where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """(u, v) with u > v -> u and its other smaller neighbours linked to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least.withColumnRenamed("u", "n"), F.col("u") == F.col("n")).where(F.col("v") != F.col("m"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that is not the least of its component; root is that least node.

    ``a`` and ``b`` are long columns. Links of a node to itself count for nothing; repeated links do
    no harm; nulls link nothing.
    """
    now = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now, mark = durable(now.distinct()), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not seen[0] or tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
        now = durable(_small_star(_large_star(now)))
