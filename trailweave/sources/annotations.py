"""Schemas and readers of annotation and feature files. All reading is Spark's."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.operators.annotate import numbered

SCHEMAS = {
    "r2r": "scan string, path_id bigint, path array<string>, heading double, instructions array<string>, instr_encodings array<array<int>>, new_instructions string, chunk_view array<array<array<int>>>",
    "r2r_aug": "scan string, instr_id string, path array<string>, heading double, instr_encoding array<int>",
    "reverie": "scan string, path_id bigint, id string, objId bigint, path array<string>, heading double, instructions array<string>",
    "reverie_aug": "scan string, instr_id string, path array<string>, heading double, instr_encoding array<int>, pos_vps array<string>",
    "soon": "scan string, path_id string, path array<string>, instructions array<struct<full:string>>, instr_encodings array<struct<full:array<int>>>, "
    "bboxes array<struct<image_id:string, pseudo_label:struct<obj_id:string>>>",
    "cvdn": "scan string, inst_idx bigint, target string, start_pano struct<pano:string,heading:double>, end_panos array<string>, planner_path array<string>, "
    "dialog_history array<struct<role:string,message:string>>",
    "eqa": "scan string, sample_idx bigint, path array<string>, question struct<question_text:string,answer_text:string>",
    "scanqa": "scene_id string, image_info array<struct<image_id:string,pose:array<array<double>>>>, "
    "annotation array<struct<question_id:string,question:string,answers:array<string>,object_ids:array<int>,object_names:array<string>>>",
    "llava": "id string, image string, conversations array<struct<`from`:string,value:string>>",
    "captions": "imgid bigint, filename string, sentences array<struct<sentid:bigint,raw:string>>",
    "connectivity": "image_id string, included boolean, unobstructed array<boolean>, pose array<double>",
}
DEBUG_ROWS = 20


def resolved(data_dir: str, folder: str, name: str) -> str:
    """An absolute or schemed folder wins; else it lies below ``data_dir``."""
    own = folder.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", folder)
    return posixpath.join(folder, name) if own else posixpath.join(data_dir, folder, name)


def records(spark: SparkSession, path: str, kind: str, debug: bool = False) -> DataFrame:
    """Records of a file with ``raw_idx``: a JSON array if its name ends in ``.json``, else JSON lines.

    Absent fields are null. ``debug`` takes the first rows alone.
    """
    whole = path.endswith(".json")
    rows = spark.read.schema(SCHEMAS[kind]).option("multiLine", whole).json(path)
    # ids grow along files and splits, with a gap of 2 ** 33 between tasks; numbering closes the gaps
    at = rows.withColumn("_id", F.monotonically_increasing_id())
    made = numbered(at, "_id", [], "raw_idx", 1 << 33).drop("_id")
    return made.orderBy("raw_idx").limit(DEBUG_ROWS) if debug else made


def visible_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(scan_vp, objid, visible_pos) from a JSON object scan_vp -> object -> record."""
    inner = "map<string,map<string,struct<visible_pos:array<int>>>>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", inner).alias("m"))
    by_vp = whole.select(F.explode("m").alias("scan_vp", "objects"))
    return by_vp.select("scan_vp", F.explode("objects").alias("objid", "o")).select("scan_vp", "objid", "o.visible_pos")


def connectivity(spark: SparkSession, pattern: str) -> DataFrame:
    """(scan, pos, vp, included, unobstructed, x, y, z) from one JSON array per scan, named ``<scan>_connectivity.json``."""
    one = f"array<struct<{', '.join(f'{a}:{b}' for a, b in (x.strip().split(' ', 1) for x in SCHEMAS['connectivity'].split(', ')))}>>"
    files = spark.read.text(pattern, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)_connectivity\.json$", 1).alias("scan"), F.from_json("value", one).alias("a"))
    rows = files.select("scan", F.posexplode("a").alias("pos", "n"))
    return rows.select("scan", "pos", F.col("n.image_id").alias("vp"), "n.included", "n.unobstructed", *(F.element_at("n.pose", k).alias(c) for k, c in ((4, "x"), (8, "y"), (12, "z"))))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows array<array<double>>) of texts that hold numbers between spaces."""
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    rows = F.transform(lines, lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda n: n.cast("double")))
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), rows.alias("rows"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) of every non-empty line, stripped: lists of scans."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def listing(spark: SparkSession, folder: str, glob: str, without: str | None = None) -> DataFrame:
    """(folder, name) of the files below ``folder``, without those whose names end in ``without``. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path")
    named = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    return named.where(~F.col("name").endswith(without)) if without else named


def features(store: DataFrame, wanted: DataFrame, keys: list[str], size: int, column: str = "ft") -> DataFrame:
    """Features of ``wanted`` keys, the first ``size`` numbers; a key the store lacks raises."""
    kept = store.select(*keys, F.slice(column, 1, size).alias(column), F.lit(True).alias("_there"))
    joined = wanted.join(kept, keys, "left")
    missing = F.raise_error(F.concat(F.lit("no feature of "), F.concat_ws("_", *keys)))
    return joined.withColumn(column, F.when(F.col("_there"), F.col(column)).otherwise(missing)).drop("_there")


def object_features(store: DataFrame, wanted: DataFrame, keys: list[str], column: str = "objects", most: int | None = None) -> DataFrame:
    """Objects of ``wanted`` keys, ``most`` at most; a key the store lacks has none."""
    joined = wanted.join(store.select(*keys, column), keys, "left")
    held = F.coalesce(F.col(column), F.array().cast(store.schema[column].dataType))
    return joined.withColumn(column, F.slice(held, 1, most) if most else held)


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under the names that other stores use."""
    return df.withColumnsRenamed(names)


def merged_config(*parts: dict) -> dict:
    """Later keys win."""
    out: dict = {}
    for p in parts:
        out |= p
    return out


def chosen_tasks(train: list[str] | None, test: list[str] | None, config: list[str]) -> list[str]:
    """Tasks named for training, else for testing, else configured."""
    return train or test or config


def mixture(tasks: list[str], known: set[str], ratios: dict[str, float] | None = None) -> dict[str, float]:
    """Weights of tasks, 1 where none is given; an unknown task is an error."""
    if unknown := [t for t in tasks if t not in known]:
        raise ValueError(f"unknown tasks: {unknown}")
    return {t: float((ratios or {}).get(t, 1)) for t in tasks}


def key_parts(column: str) -> tuple[Column, Column]:
    """Scan and viewpoint of a joined key, cut at the first underscore."""
    parts = F.split(column, "_", 2)
    return parts[0], parts[1]
