"""Queries of stores: page files of records, and feature matrices in blocks of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.sources import annotations, matrixstore, pagefile
from trailweave.sources.durable import shared_folder
from trailweave.sources.tables import table

RECORD = "key string, fts array<array<double>>, obj_ids array<string>, `2d_centers` array<array<double>>, xyxy_bboxes array<array<long>>"


def _viewpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding as a viewpoint's objects: its numbers in rows of eight, as many objects as its id says (0 to 8)."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice(F.col("v"), k * 8 + 1, 8))
    e = table(spark, sf, "embeddings").select("vec_id", "label", wide.alias("v")).withColumn("n", (F.col("vec_id") % 9).cast("int"))
    return e.select("vec_id", "label", F.concat_ws("_", F.concat(F.lit("s"), F.col("label").cast("string")), F.format_string("%09d", F.col("vec_id"))).alias("key"), F.slice(rows, F.lit(1), F.col("n")).alias("fts"), "n")


def _store(spark: SparkSession, sf: str) -> str:
    """The viewpoints with objects, written as a page file store."""
    each = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))
    v = _viewpoints(spark, sf).where("n > 0").withColumn("each", each)
    made = v.select(
        "key", "fts", F.transform("each", lambda k: F.concat(F.col("vec_id").cast("string"), F.lit("-"), k.cast("string"))).alias("obj_ids"),
        F.transform("each", lambda k: F.array(k / 10.0, -k / 20.0)).alias("2d_centers"), F.transform("each", lambda k: F.array(k.cast("long"), k * 2, k + 100, k * 2 + 50)).alias("xyxy_bboxes"),
    )
    path = f"{shared_folder(spark)}/objects"
    pagefile.written(made, path)
    return path


def _sum(column: str) -> Column:
    return F.round(F.aggregate(F.flatten(column), F.lit(0.0), lambda a, x: a + x), 6)


def src13_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every record of a page file store, by a scan of its leaves."""
    r = pagefile.read(spark, _store(spark, sf), RECORD)
    scan, vp = annotations.key_parts("key")
    return r.select(scan.alias("scan"), vp.alias("vp"), F.size("fts").alias("n_objects"), _sum("fts").alias("total"), F.array_join("obj_ids", ",").alias("ids"))


def src10_objects(spark: SparkSession, sf: str) -> DataFrame:
    """The objects of all viewpoints, three at most, the first five numbers of each; a viewpoint that the store lacks has none."""
    store = pagefile.read(spark, _store(spark, sf), RECORD)
    cut = F.transform("fts", lambda r: F.slice(r, 1, 5))
    objects = F.arrays_zip(cut.alias("ft"), F.col("obj_ids").alias("id"))
    wanted = _viewpoints(spark, sf).select("vec_id", "key")
    got = annotations.object_features(store.select("key", objects.alias("objects")), wanted, ["key"], "objects", 3)
    return got.select("vec_id", F.size("objects").alias("n_objects"), _sum("objects.ft").alias("total"), F.array_join("objects.id", ",").alias("ids"))


def src11_renamed(spark: SparkSession, sf: str) -> DataFrame:
    """The same store under the names of another source, from a range of keys: the viewpoints of scan 3."""
    store = pagefile.read(spark, _store(spark, sf), RECORD, from_="s3_", until="s3`")
    r = annotations.renamed(store, {"2d_centers": "directions", "xyxy_bboxes": "bboxes"})
    return r.select("key", F.size("directions").alias("n"), F.round(F.col("directions")[0][0], 6).alias("heading"), F.element_at("bboxes", -1)[3].alias("bottom"))


def snk07_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Feature matrices written in blocks of columns with what describes them, and their first five columns read back."""
    path = f"{shared_folder(spark)}/matrices"
    matrixstore.written(_viewpoints(spark, sf).select("key", "label", "vec_id", "fts"), path, "key", "fts", columns=8, block=4)
    back = matrixstore.read(spark, path, first=5)
    last = F.when(F.size("matrix") > 0, F.get(F.element_at("matrix", F.size("matrix")), F.lit(4)).cast("double"))
    return back.select("key", "vec_id", "label", F.size("matrix").alias("n_rows"), F.coalesce(F.size(F.get("matrix", F.lit(0))), F.lit(0)).alias("n_columns"), F.round(last, 6).alias("last"))


QUERIES = {f.__name__: f for f in (src13_records, src10_objects, src11_renamed, snk07_matrix)}

_V = """v AS (SELECT vec_id, label, 's' || label || '_' || lpad(CAST(vec_id AS VARCHAR), 9, '0') AS key, CAST(vec_id % 9 AS INTEGER) AS n,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"""
ORACLE = {
    "src13_records": f"""WITH {_V}
SELECT 's' || label AS scan, lpad(CAST(vec_id AS VARCHAR), 9, '0') AS vp, n AS n_objects, round(list_sum(e[1:8 * n]), 6) AS total,
       array_to_string(list_transform(range(1, n + 1), lambda k: vec_id || '-' || k), ',') AS ids FROM v WHERE n > 0""",
    "src10_objects": f"""WITH {_V}, w AS (SELECT *, CAST(least(n, 3) AS INTEGER) AS m FROM v)
SELECT vec_id, m AS n_objects, round(coalesce(list_sum(flatten(list_transform(range(m), lambda k: e[8 * k + 1:8 * k + 5]))), 0), 6) AS total,
       array_to_string(list_transform(range(1, m + 1), lambda k: vec_id || '-' || k), ',') AS ids FROM w""",
    "src11_renamed": f"""WITH {_V} SELECT key, n, 0.1 AS heading, CAST(n * 2 + 50 AS BIGINT) AS bottom FROM v WHERE n > 0 AND label = 3""",
    "snk07_matrix": f"""WITH {_V} SELECT key, vec_id, label, n AS n_rows, CASE WHEN n > 0 THEN 5 ELSE 0 END AS n_columns, CASE WHEN n > 0 THEN round(e[8 * (n - 1) + 5], 6) END AS last FROM v""",
}
