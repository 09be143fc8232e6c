"""Predictions in the shapes of the tasks' result files, and writers.

Every shape is a DataFrame; ``write_json`` writes any of them as one JSON object per line and part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.operators.annotate import numbered
from trailweave.sources.durable import durable


def flat_steps(trajectory: str) -> Column:
    """Segments as one list of [viewpoint, 0, 0], numbers as text."""
    return F.transform(F.flatten(trajectory), lambda v: F.array(v.cast("string"), F.lit("0"), F.lit("0")))


def with_metrics(preds: DataFrame, metrics: DataFrame) -> DataFrame:
    """Predictions with their own scores, by id (never by position)."""
    return preds.join(metrics, "instr_id", "left")


def navigation_file(preds: DataFrame) -> DataFrame:
    """Ids without their task's prefix, flat steps."""
    return preds.withColumn("instr_id", F.regexp_replace("instr_id", "^[^_]*_", "")).withColumn("trajectory", flat_steps("trajectory"))


def grounding_file(preds: DataFrame) -> DataFrame:
    """The same with the predicted object's number, 0 for none."""
    return navigation_file(preds).withColumn("predObjId", F.coalesce(F.col("pred_objid").cast("int"), F.lit(0))).drop("pred_objid")


def search_file(preds: DataFrame) -> DataFrame:
    """Number from the id's third field, up to a dash; path and direction nested, 0 for no direction."""
    number = F.split(F.split("instr_id", "_")[2], "-")[0].cast("int")
    angle = lambda k: F.array(F.coalesce(F.get("pred_obj_direction", F.lit(k)), F.lit(0.0)))
    nested = F.array(F.struct(flat_steps("trajectory").alias("path"), angle(0).alias("obj_heading"), angle(1).alias("obj_elevation")))
    return preds.select(number.alias("instr_id"), nested.alias("trajectory"))


def dialog_file(preds: DataFrame) -> DataFrame:
    """Flat steps, and the id's last field as a number under both names."""
    number = F.element_at(F.split("instr_id", "_"), -1).cast("int")
    return preds.withColumn("trajectory", flat_steps("trajectory")).withColumn("instr_idx", number).withColumn("inst_idx", number)


def question_file(preds: DataFrame) -> DataFrame:
    """Scene questions: answers under the leaderboard's name, with empty boxes."""
    return preds.withColumnRenamed("generated_sentences", "answer_top10").withColumn("pred_bbox", F.array().cast("array<double>"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; nulls are written, text keeps its characters."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_features(df: DataFrame, path: str, columns: list[str], keys: list[str]) -> None:
    """Features and their metadata as two tables: JSON lines without ``columns``, Parquet with keys and ``columns`` alone.

    Rows of both carry their place in the order of ``keys`` as ``row``, so the tables stay aligned however
    they are read. The numbering is made once and kept while both are written.
    """
    at = df.withColumn("_id", F.xxhash64(*keys).bitwiseAND(F.lit((1 << 40) - 1)))
    rows = durable(numbered(at, "_id", keys, "row", 1 << 32).drop("_id"))
    rows.drop(*columns).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/metadata")
    rows.select("row", *keys, *columns).write.mode("overwrite").parquet(f"{path}/features")


def answer_file(preds: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """Question answering on walks: predictions as they are, with their own scores if there are any."""
    return preds if metrics is None else with_metrics(preds, metrics)


def graph_json(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, json): a graph memory's nodes and edges as one text."""
    n = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*(c for c in nodes.columns if c not in keys)))).alias("nodes"))
    e = edges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*(c for c in edges.columns if c not in keys)))).alias("edges"))
    return n.join(e, keys, "left").select(*keys, F.to_json(F.struct("nodes", F.coalesce("edges", F.array().cast(e.schema["edges"].dataType)).alias("edges"))).alias("json"))
