"""Navigation tables derived from the benchmark tables, which have no annotations of their own.

scan = an embedding's label and a range of its id, viewpoint = its id, position = its first three numbers;
viewpoints closer than RADIUS are linked. So a scan stays a building of some 200 viewpoints, and more
data is more scans. A trajectory is what a user did in a week: each event is hashed to a viewpoint
of the scan's largest connected part; the goal is hashed from user and week.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.operators import graph
from trailweave.sources.durable import durable
from trailweave.sources.tables import table

RADIUS = 0.2
#: Labels of the embeddings, and how many ids share a scan of each.
LABELS = 10
IDS_OF_A_SCAN = 2000
WEEK = 604_800


def scan() -> Column:
    """The scan of an embedding."""
    return (F.col("label") + LABELS * F.floor(F.col("vec_id") / IDS_OF_A_SCAN)).cast("int")


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """(scan, vp, x, y, z)."""
    at = [F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")]
    return table(spark, sf, "embeddings").select(scan().alias("scan"), F.col("vec_id").alias("vp"), *at)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """(scan, src, dst, w)."""
    return graph.radius_edges(nodes(spark, sf), RADIUS)


def dist(spark: SparkSession, sf: str) -> DataFrame:
    """(scan, src, dst, d)."""
    return graph.distances(edges(spark, sf), nodes(spark, sf))


def reach_of(d: DataFrame) -> DataFrame:
    """(scan, vp, reach) from kept distances."""
    return d.groupBy("scan", F.col("src").alias("vp")).agg(F.count(F.lit(1)).alias("reach"))


def picks(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """(scan, k, vp, n): the viewpoints of each scan's largest connected part, numbered from 0. ``of``: kept ``graph.reached``."""
    reach = graph.reached(edges(spark, sf), nodes(spark, sf)) if of is None else of
    most = reach.groupBy("scan").agg(F.max("reach").alias("most"))
    able = reach.join(most, "scan").where("reach = most")
    by_scan = Window.partitionBy("scan")
    return able.select("scan", "vp", (F.row_number().over(by_scan.orderBy("vp")) - 1).cast("long").alias("k"), F.count(F.lit(1)).over(by_scan).alias("n"))


def steps(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """(instr_id, user_id, week, scan, pos, node, goal): one row per step of a trajectory."""
    p = durable(picks(spark, sf)) if of is None else of  # read three times
    size = p.select("scan", "n").distinct()
    scans = nodes(spark, sf).agg((F.max("scan") + 1).alias("scans"))  # one row
    e = table(spark, sf, "events").crossJoin(F.broadcast(scans))
    e = e.select("event_id", "user_id", "ts", F.floor(F.unix_timestamp("ts") / WEEK).alias("week"), (F.col("user_id") % F.col("scans")).cast("int").alias("scan"))
    order = Window.partitionBy("user_id", "week").orderBy("ts", "event_id")
    e = e.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).join(size, "scan")
    e = e.withColumn("k", (F.col("event_id") * 7919 + F.col("pos")) % F.col("n")).withColumn("kg", (F.col("user_id") * 31 + F.col("week") * 17) % F.col("n"))
    at = p.select("scan", "k", F.col("vp").alias("node"))
    to = p.select("scan", F.col("k").alias("kg"), F.col("vp").alias("goal"))
    return e.join(at, ["scan", "k"]).join(to, ["scan", "kg"]).select(
        F.concat_ws("_", F.lit("r2r"), "user_id", "week").alias("instr_id"), "user_id", "week", "scan", "pos", "node", "goal"
    )


def predictions(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """(instr_id, user_id, week, scan, goal, trajectory array<array<long>>): a segment per step, as agents report them."""
    return (
        steps(spark, sf, of)
        .groupBy("instr_id", "user_id", "week", "scan", "goal")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda s: F.array(s["node"])).alias("trajectory"))
    )


def ground_truth(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """(instr_id, scan, path): the annotated path, here its two ends (their distance is the path's length)."""
    p = predictions(spark, sf, of)
    return p.select("instr_id", "scan", F.array(F.flatten("trajectory")[0], "goal").alias("path"))


def dialogs(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, target, dialog_history array<struct<role,message>>): conversations as navigator and oracle turns."""
    role = F.when(F.col("role") == "user", "navigator").when(F.col("role") == "assistant", "oracle")
    turns = table(spark, sf, "conversations").withColumn("r", role).where(F.col("r").isNotNull() & (F.length("text") > 0))
    history = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("r").alias("role"), F.col("text").alias("message")))), lambda t: F.struct(t["role"].alias("role"), t["message"].alias("message")))
    return turns.groupBy("conv_id").agg(history.alias("dialog_history")).withColumn("target", F.concat(F.lit("item"), F.col("conv_id").cast("string")))
