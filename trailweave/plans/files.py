"""Queries of annotation, configuration and image files: each is written from the tables and read back by its reader."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.operators import annotate as A
from trailweave.operators import graph, trajectory
from trailweave.plans.base_sql import NODES, WALKED, words_sql
from trailweave.sources import annotations, catalog, sinks, views
from trailweave.sources.durable import shared_folder
from trailweave.sources.pagefile import filesystem
from trailweave.sources.tables import table

#: Records of one file that holds a JSON array.
ARRAY_ROWS = 500


def _arrays(rows: DataFrame, folder: str) -> str:
    """Write (record struct, bucket) as files that hold one JSON array each; a folder named like such a file."""
    one = rows.groupBy("bucket").agg(F.to_json(F.collect_list("record")).alias("value"))
    one.repartition("bucket").write.partitionBy("bucket").text(folder)
    return folder


def _lines(rows: DataFrame, folder: str) -> str:
    rows.write.json(folder)
    return folder


def _part_records(spark: SparkSession, sf: str, more: list[Column]) -> DataFrame:
    """(record, bucket): parts as annotations with two instructions, on a path of type and brand."""
    p = table(spark, sf, "part").withColumn("scan", F.concat(F.lit("s"), F.col("p_size").cast("string")))
    record = F.struct("scan", F.array("p_type", "p_brand").alias("path"), *more)
    return p.select(record.alias("record"), F.floor(F.col("p_partkey") / ARRAY_ROWS).cast("int").alias("bucket"), "p_partkey")


def src02_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Room-to-room records read from files of JSON arrays: a row per instruction, an absent heading as 0."""
    more = [F.col("p_partkey").alias("path_id"), F.array("p_name", "p_type").alias("instructions"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") / 10.0).alias("heading")]
    path = _arrays(_part_records(spark, sf, more), f"{shared_folder(spark)}/r2r.json")
    r = A.instruction_rows(annotations.records(spark, path, "r2r"))
    return r.select("instr_id", "scan", F.element_at("path", -1).alias("goal"), "instruction", F.round("heading", 6).alias("heading"))


def src04_search(spark: SparkSession, sf: str) -> DataFrame:
    """Object-search records read from JSON lines: whole instructions, their codes cut to a hundred, boxes by image, the last of equal ones."""
    box = lambda image, of: F.struct(F.lit(image).alias("image_id"), F.struct(F.col(of).alias("obj_id")).alias("pseudo_label"))
    codes = F.sequence(F.lit(1), F.col("p_size") * 4)
    more = [
        F.col("p_partkey").cast("string").alias("path_id"), F.array(F.struct(F.col("p_name").alias("full")), F.struct(F.col("p_type").alias("full"))).alias("instructions"),
        F.array(F.struct(codes.alias("full")), F.struct(F.slice(codes, 1, 3).alias("full"))).alias("instr_encodings"), F.array(box("a", "p_type"), box("b", "p_brand"), box("a", "p_name")).alias("bboxes"),
    ]
    path = _lines(_part_records(spark, sf, more).select("record.*"), f"{shared_folder(spark)}/soon.jsonl")
    r = A.search_rows(annotations.records(spark, path, "soon"))
    label = lambda k: F.col("image_id_to_obj_label")[k]["obj_id"]
    return r.select(F.regexp_replace("instr_id", "^soon_[0-9]+_", "").alias("id"), "instruction", F.size("instr_encoding").alias("n_codes"), F.array_join("end_image_ids", ",").alias("ends"), label("a").alias("label_a"), label("b").alias("label_b"), "heading", "data_type")


def jon02_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Remote-grounding records from files of JSON arrays, each joined with the viewpoints that show its object, which must be known."""
    more = [F.col("p_partkey").alias("path_id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") % 50).alias("objId"), F.array("p_name").alias("instructions")]
    path = _arrays(_part_records(spark, sf, more), f"{shared_folder(spark)}/reverie.json")
    boxes = table(spark, sf, "part").select(F.concat_ws("_", F.concat(F.lit("s"), F.col("p_size").cast("string")), F.col("p_partkey").cast("string")).alias("scan_vp"), (F.col("p_partkey") % 50).alias("objid"), F.when(F.col("p_partkey") % 4 != 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("visible_pos"))
    records = annotations.records(spark, path, "reverie").withColumnRenamed("objId", "objid")
    r = A.object_rows(records, A.object_viewpoints(boxes))
    return r.select("instr_id", "scan", "objid", F.size("end_vps").alias("n_ends"), F.md5(F.array_join("end_vps", ",")).alias("ends_md5"))


def prj09_augmented(spark: SparkSession, sf: str) -> DataFrame:
    """Augmented remote-grounding lines: their viewpoints come under the other records' name."""
    p = table(spark, sf, "part").select(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("scan"), F.concat_ws("_", F.lit("aug"), "p_partkey").alias("instr_id"), F.array("p_type").alias("path"), F.array("p_brand", "p_name").alias("pos_vps"))
    r = annotations.records(spark, _lines(p, f"{shared_folder(spark)}/aug.jsonl"), "reverie_aug")
    r = annotations.renamed(r, {"pos_vps": "end_vps"})
    return r.select("instr_id", "scan", F.array_join("end_vps", ",").alias("end_vps"), F.coalesce("heading", F.lit(0.0)).alias("heading"))


def src05_dialogs(spark: SparkSession, sf: str) -> DataFrame:
    """Dialog records read from JSON lines as one instruction each, cut to 128 words; without a planner's path they begin where they start."""
    d = views.dialogs(spark, sf)
    made = d.select(F.lit("s").alias("scan"), F.col("conv_id").alias("inst_idx"), "target", F.struct(F.lit("p0").alias("pano"), F.lit(0.5).alias("heading")).alias("start_pano"), F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("p0"), F.lit("p1"))).alias("planner_path"), "dialog_history")
    r = annotations.records(spark, _lines(made, f"{shared_folder(spark)}/cvdn.jsonl"), "cvdn")
    rows = A.dialog_rows(r.withColumn("start_pano", F.col("start_pano.pano")))
    return rows.select("inst_idx", F.md5("instruction").alias("md5"), F.array_join("path", ",").alias("path"), "data_type")


def src07_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    """A connectivity file for each scan, written by the scans' tasks and read into edges: every viewpoint is open to those whose place is near its own."""
    folder = f"{shared_folder(spark)}/connectivity"
    n = views.nodes(spark, sf)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vp")
        rows = []
        for k, r in enumerate(pdf.itertuples(index=False)):
            pose = [0.0] * 16
            pose[3], pose[7], pose[11] = r.x, r.y, r.z
            rows.append({"image_id": str(r.vp), "included": r.vp % 5 != 0, "unobstructed": [abs(k - j) <= 2 and j != k for j in range(len(pdf))], "pose": pose})
        files, at = filesystem(folder)
        files.create_dir(at, recursive=True)
        with files.open_output_stream(f"{at}/{pdf['scan'].iloc[0]}_connectivity.json") as out:
            out.write(json.dumps(rows).encode())
        return pdf[["scan"]].head(1)

    n.groupBy("scan").applyInPandas(write, "scan int").count()
    e = graph.connectivity_edges(annotations.connectivity(spark, f"{folder}/*_connectivity.json"))
    return e.select(F.col("scan").cast("int").alias("scan"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.round("w", 6).alias("w"))


def src18_answers(spark: SparkSession, sf: str) -> DataFrame:
    """An answer vocabulary read from its JSON array, and how many parts have each answer as their type."""
    p = table(spark, sf, "part")
    types = p.select("p_type").distinct().agg(F.to_json(F.array_sort(F.collect_set("p_type"))).alias("value"))  # a vocabulary is one array
    folder = f"{shared_folder(spark)}/answers"
    types.coalesce(1).write.text(folder)
    v = catalog.vocabulary(spark, folder)
    return v.join(F.broadcast(p.groupBy(F.col("p_type").alias("answer")).agg(F.count(F.lit(1)).alias("n"))), "answer").select("place", "answer", "n")


def cfg_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks and their weights from two configuration files, the later winning; an absent ratio is 1. Tasks are the customers' segments."""
    folder = shared_folder(spark)
    c = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    for part, ratio in (("base", F.col("n") % 7 + 1.0), ("stage", F.when(F.col("n") % 2 == 0, F.col("n") % 5 + 2.0))):
        of = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "r"))))
        c.withColumn("r", ratio).where("r IS NOT NULL").agg(F.to_json(F.struct(of.alias(f"{part}_ratios"))).alias("value")).coalesce(1).write.text(f"{folder}/{part}.json")
    read = [catalog.read_config(spark, f"{folder}/{k}.json") for k in ("base", "stage")]
    config = annotations.merged_config(read[0], read[1], {"ratios": annotations.merged_config(read[0].get("base_ratios", {}), read[1].get("stage_ratios", {}))})
    known = set(config["ratios"])
    tasks = annotations.chosen_tasks(None, None, sorted(known))
    weights = annotations.mixture(tasks, known, {k: v for k, v in config["ratios"].items() if v != 3.0})
    w = spark.createDataFrame(sorted(weights.items()), "name string, weight double")  # as many rows as the configuration has tasks
    return c.join(F.broadcast(w), "name").select("name", "weight", (F.col("weight") * F.col("n")).alias("drawn"))


def snk11_scenes(spark: SparkSession, sf: str) -> DataFrame:
    """Questions by scene with the scene's images in order, written as JSON lines and read back; suppliers are scenes, their parts images."""
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber").withColumn("scene_id", F.concat_ws("_", F.lit("scene"), "l_suppkey"))  # noqa: E741
    q = l.where("l_linenumber = 1").select("scene_id", F.col("l_orderkey").cast("string").alias("question_id"), F.concat(F.lit("which "), F.col("l_partkey").cast("string")).alias("question"), F.array(F.col("l_partkey").cast("string")).alias("answers"))
    i = l.where("l_suppkey % 3 <> 0").select("scene_id", F.col("l_partkey").cast("string").alias("image_id"), F.array(F.lit(1.0)).alias("pose")).distinct()
    made, _ = A.scenes(q, i)
    folder = shared_folder(spark)
    sinks.write_json(made, folder)
    back = spark.read.schema("scene_id string, annotation array<struct<question_id:string,question:string,answers:array<string>>>, image_info array<struct<image_id:string,pose:array<double>>>").json(folder)
    return back.select("scene_id", F.size("annotation").alias("n_questions"), F.size("image_info").alias("n_images"), F.md5(F.array_join("image_info.image_id", ",")).alias("images_md5"), F.md5(F.array_join("annotation.question_id", ",")).alias("questions_md5"))


def prj22_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with fields that only some tasks have, and with their own scores where there are any, met by id."""
    p = views.predictions(spark, sf)
    preds = p.select("instr_id", "trajectory", F.when(F.col("user_id") % 2 == 0, F.col("week").cast("string")).alias("generated_sentences"), F.when(F.col("user_id") % 3 == 0, F.col("goal")).alias("pred_objid"))
    metrics = p.where("week % 2 = 0").select("instr_id", F.size("trajectory").alias("steps"))
    folder = shared_folder(spark)
    sinks.write_json(sinks.with_metrics(preds, metrics), folder)
    back = spark.read.schema("instr_id string, trajectory array<array<long>>, generated_sentences string, pred_objid long, steps int").json(folder)
    return back.select("instr_id", F.size("trajectory").alias("n"), "generated_sentences", "pred_objid", "steps")


def flt07_offenders(spark: SparkSession, sf: str) -> DataFrame:
    """What would stop a scoring: predictions without a ground truth, and those that start elsewhere. Every seventh user has none, every eleventh's is turned."""
    p = views.predictions(spark, sf)
    path = F.array(F.flatten("trajectory")[0], "goal")
    gt = p.where("user_id % 7 <> 0").select("instr_id", "scan", F.when(F.col("user_id") % 11 == 0, F.reverse(path)).otherwise(path).alias("path"))
    return trajectory.offenders(p.select("instr_id", "trajectory"), gt)


SIDE = 8


def _bitmap(values: list[int]) -> bytes:
    """A picture of SIDE x SIDE dots of 24 bits (blue and green as given, red the rest to 255), rows from the bottom up."""
    rows = [values[k : k + SIDE] for k in range(0, SIDE * SIDE, SIDE)]
    body = b"".join(bytes(x for v in r for x in (v, v, 255 - v)) for r in reversed(rows))
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, SIDE, SIDE, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def src17_images(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures from two folders, the first that has one counts, decoded; names that no folder has give nulls. Every embedding is a picture."""
    folder = shared_folder(spark)
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127).cast("int")).alias("v"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i, v in zip(f["vec_id"], f["v"]):
                for place in [p for p, keeps in (("train", i % 3 != 0), ("val", i % 3 != 1)) if keeps and i % 5]:
                    files, at = filesystem(f"{folder}/{place}")
                    files.create_dir(at, recursive=True)
                    with files.open_output_stream(f"{at}/{i}.bmp") as out:
                        out.write(_bitmap([x if place == "train" else 255 - x for x in v]))
            yield f[["vec_id"]]

    e.mapInPandas(write, "vec_id long").count()
    wanted = e.select("vec_id", F.concat(F.col("vec_id").cast("string"), F.lit(".bmp")).alias("image"))
    got = catalog.decoded_images(spark, wanted, [f"{folder}/train", f"{folder}/val"])
    dot = lambda k: F.conv(F.hex(F.substring(F.col("pixels"), k + 1, 1)), 16, 10).cast("int")
    return got.select("vec_id", "height", "width", "channels", F.length("pixels").alias("n"), dot(0).alias("first_blue"), dot(2).alias("first_red"), dot(SIDE * SIDE * 3 - 3).alias("last_blue"))


QUERIES = {
    f.__name__: f
    for f in (
        src02_arrays, src04_search, jon02_grounding, prj09_augmented, src05_dialogs, src07_connectivity, src18_answers, cfg_mixture, snk11_scenes, prj22_predictions, flt07_offenders, src17_images,
    )
}


ORACLE = {
    "src02_arrays": """SELECT 'r2r_' || p_partkey || '_' || j AS instr_id, 's' || p_size AS scan, p_brand AS goal, [p_name, p_type][j + 1] AS instruction,
  CASE WHEN p_partkey % 3 = 0 THEN round(p_size / 10.0, 6) ELSE 0.0 END AS heading FROM part, (SELECT unnest([0, 1]) AS j)""",
    "src04_search": """SELECT p_partkey || '_' || j AS id, [p_name, p_type][j + 1] AS instruction, CAST(CASE WHEN j = 1 THEN 3 ELSE least(p_size * 4, 100) END AS INTEGER) AS n_codes, 'a,b,a' AS ends,
  p_name AS label_a, p_brand AS label_b, 0.0::DOUBLE AS heading, 'soon' AS data_type FROM part, (SELECT unnest([0, 1]) AS j)""",
    "jon02_grounding": """WITH seen AS (SELECT p_size, p_partkey % 50 AS objid, count(*) AS n, md5(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY CAST(p_partkey AS VARCHAR))) AS m FROM part WHERE p_partkey % 4 <> 0 GROUP BY 1, 2)
SELECT concat_ws('_', 'reverie', p.p_partkey, CASE WHEN p.p_partkey % 4 <> 0 THEN p.p_partkey % 50 END, 0) AS instr_id, 's' || p.p_size AS scan, CASE WHEN p.p_partkey % 4 <> 0 THEN p.p_partkey % 50 END AS objid, s.n AS n_ends, s.m AS ends_md5
FROM part p LEFT JOIN seen s ON s.p_size = p.p_size AND p.p_partkey % 4 <> 0 AND s.objid = p.p_partkey % 50""",
    "prj09_augmented": "SELECT 'aug_' || p_partkey AS instr_id, 's' || p_size AS scan, p_brand || ',' || p_name AS end_vps, 0.0::DOUBLE AS heading FROM part",
    "src05_dialogs": f"""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Question: ' ELSE 'Answer: ' END || text || CASE WHEN right(text, 1) IN ('?', '.') THEN '' ELSE '.' END || chr(10) AS line
  FROM conversations WHERE role IN ('user', 'assistant') AND length(text) > 0),
d AS (SELECT conv_id, 'The goal room contains a item' || conv_id || '.' || chr(10) || string_agg(line, '' ORDER BY turn) AS t FROM t GROUP BY 1),
s AS (SELECT conv_id, left(t, length(t) - 1) AS t FROM d), w AS (SELECT *, {words_sql("t")} AS w FROM s)
SELECT conv_id AS inst_idx, md5(CASE WHEN len(w) > 128 THEN array_to_string(w[1:128], ' ') ELSE t END) AS md5, CASE WHEN conv_id % 2 = 0 THEN 'p0,p1' ELSE 'p0' END AS path, 'cvdn' AS data_type FROM w""",
    "src07_connectivity": f"""WITH {NODES}, k AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY vp) AS k FROM nodes)
SELECT a.scan, a.vp AS src, b.vp AS dst, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), 6) AS w
FROM k a JOIN k b ON a.scan = b.scan AND a.k <> b.k AND abs(a.k - b.k) <= 2 WHERE a.vp % 5 <> 0 AND b.vp % 5 <> 0""",
    "src18_answers": "SELECT CAST(row_number() OVER (ORDER BY p_type) - 1 AS INTEGER) AS place, p_type AS answer, count(*) AS n FROM part GROUP BY p_type",
    "cfg_mixture": """WITH c AS (SELECT c_mktsegment AS name, count(*) AS n FROM customer GROUP BY 1),
r AS (SELECT *, CASE WHEN n % 2 = 0 THEN n % 5 + 2.0 ELSE n % 7 + 1.0 END AS r FROM c)
SELECT name, CAST(CASE WHEN r = 3 THEN 1 ELSE r END AS DOUBLE) AS weight, CAST(CASE WHEN r = 3 THEN 1 ELSE r END * n AS DOUBLE) AS drawn FROM r""",
    "snk11_scenes": """WITH q AS (SELECT l_suppkey, count(*) AS n, md5(string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY CAST(l_orderkey AS VARCHAR), l_partkey)) AS m FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
i AS (SELECT l_suppkey, count(*) AS n, md5(string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_partkey)) AS m FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey % 3 <> 0) GROUP BY 1)
SELECT 'scene_' || l_suppkey AS scene_id, q.n AS n_questions, i.n AS n_images, i.m AS images_md5, q.m AS questions_md5 FROM q JOIN i USING (l_suppkey)""",
    "prj22_predictions": f"""WITH {WALKED} SELECT instr_id, n, CASE WHEN user_id % 2 = 0 THEN CAST(week AS VARCHAR) END AS generated_sentences, CASE WHEN user_id % 3 = 0 THEN goal END AS pred_objid, CASE WHEN week % 2 = 0 THEN n END AS steps FROM walked""",
    "flt07_offenders": f"""WITH {WALKED} SELECT instr_id, CASE WHEN user_id % 7 = 0 THEN 'unknown' ELSE 'start' END AS why FROM walked WHERE user_id % 7 = 0 OR (user_id % 11 = 0 AND first_node <> goal)""",
    "src17_images": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1) * 127) AS INTEGER)) AS v, vec_id % 5 <> 0 AS there, vec_id % 3 <> 0 AS train FROM embeddings),
p AS (SELECT *, CASE WHEN train THEN v[1] ELSE 255 - v[1] END AS a, CASE WHEN train THEN v[64] ELSE 255 - v[64] END AS z FROM v)
SELECT vec_id, CASE WHEN there THEN 8 END AS height, CASE WHEN there THEN 8 END AS width, CASE WHEN there THEN 3 END AS channels, CASE WHEN there THEN 192 END AS n,
       CASE WHEN there THEN a END AS first_blue, CASE WHEN there THEN 255 - a END AS first_red, CASE WHEN there THEN z END AS last_blue FROM p""",
}
