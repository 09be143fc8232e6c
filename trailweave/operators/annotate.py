"""Annotation records to rows: one per instruction, question, turn pair or caption.

Records come nested, as their files hold them (schemas in ``sources.annotations``); optional fields are
null where absent. Arrays are exploded with their positions; an empty array gives no rows.
"""

from __future__ import annotations

import ast
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailweave.functions.arrays import bound, first_words, run_lengths, stripped

FULL = 2 * math.pi


def numbered(df: DataFrame, key: str, order: list[str], out: str = "sample_idx", width: int = 100_000) -> DataFrame:
    """``out``: the place of each row in the order of ``key`` (a whole number, the raw record's place), then ``order``.

    Rows are numbered inside ranges of ``width`` keys and moved up by how many rows the ranges before
    have, so no task sees more than a range; the counts of ranges are the only thing ordered globally.
    """
    ranged = df.withColumn("_range", F.floor(F.col(key) / width))
    before = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key, *order)) - 1
    return ranged.withColumn("_k", inside).join(before, "_range").withColumn(out, F.col("_before") + F.col("_k")).drop("_range", "_k", "_before")


def running_sums(df: DataFrame, keys: list[str], order: str, value: str, width: int = 100_000) -> DataFrame:
    """``n_before`` and ``sum_before``: of the rows of the same keys that come before in ``order`` (a whole number, no two alike).

    As with ``numbered``, a task sees a range of ``width`` numbers; of a key only the sums of its ranges are
    ordered as a whole.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / width))
    sums = ranged.groupBy(*keys, "_range").agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_range", F.sum("_n").over(earlier).alias("_n0"), F.sum("_s").over(earlier).alias("_s0"))
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = ranged.withColumn("_k", F.count(value).over(inside)).withColumn("_t", F.sum(value).over(inside)).join(sums, [*keys, "_range"])
    return rows.withColumn("n_before", zero("_n0") + F.col("_k")).withColumn("sum_before", zero("_s0") + zero("_t")).drop("_range", "_k", "_t", "_n0", "_s0")


def by_instruction(df: DataFrame, array: str = "instructions") -> DataFrame:
    """One row per instruction with its place ``j``; the array goes, all else stays."""
    return df.select(*(c for c in df.columns if c != array), F.posexplode(array).alias("j", "instruction"))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.StringType()))))
def literal_lists(texts: pd.Series) -> pd.Series:
    """Nested lists written as Python literals, for texts that JSON can't read; nothing is evaluated."""
    return texts.map(lambda t: ast.literal_eval(t) if t else None)


def fine_grained(df: DataFrame) -> DataFrame:
    """Rows with ``new_instructions`` (a list of lists in a text), ``chunk_view`` and ``j``: the j-th sub-instructions and views.

    JSON-like texts are read JVM-side; others by a literal parser. Rows whose list is too short have none.
    """
    read = F.coalesce(F.from_json("new_instructions", "array<array<array<string>>>"), literal_lists("new_instructions"))
    d = df.withColumn("_new", read)
    have = F.coalesce(F.size("_new") > F.col("j"), F.lit(False))
    parts = F.transform(F.get("_new", F.col("j")), lambda words: F.array_join(words, " "))
    return d.withColumn("fg_instruction", F.when(have, parts)).withColumn("fg_view", F.when(have, run_lengths(F.get("chunk_view", F.col("j"))))).drop("_new", "new_instructions", "chunk_view")


def instruction_rows(df: DataFrame, longest: int = 200) -> DataFrame:
    """Room-to-room records: (raw_idx, path_id, scan, path, heading, instructions, instr_encodings).

    Each instruction takes its own encoding, cut, before rows are numbered: no row carries those of the whole record.
    """
    own = lambda all_: F.transform("instructions", lambda s, j: F.struct(s.alias("instruction"), F.slice(F.get(all_, j), 1, longest).alias("instr_encoding")))
    paired = df.withColumn("instructions", bound(F.col("instr_encodings"), own)).drop("instr_encodings")
    each = by_instruction(paired).withColumn("instr_encoding", F.col("instruction.instr_encoding")).withColumn("instruction", F.col("instruction.instruction"))
    rows = numbered(each, "raw_idx", ["j"], width=1000)
    rows = rows.withColumn("instr_id", F.concat_ws("_", F.lit("r2r"), "path_id", "j"))
    return rows.withColumn("heading", F.coalesce("heading", F.lit(0.0))).withColumn("data_type", F.lit("r2r"))


def object_viewpoints(boxes: DataFrame) -> DataFrame:
    """(scan, objid, end_vps) from (scan_vp, objid, visible_pos): where each object is visible, in order and with repeats."""
    at = F.split("scan_vp", "_", 2)
    seen = boxes.where(F.size("visible_pos") > 0).select(at[0].alias("scan"), "objid", at[1].alias("vp"))
    return seen.groupBy("scan", "objid").agg(F.array_sort(F.collect_list("vp")).alias("end_vps"))


def object_rows(df: DataFrame, viewpoints: DataFrame) -> DataFrame:
    """Remote-grounding records: the id names the object if there is one, and its viewpoints must be known."""
    rows = numbered(by_instruction(df), "raw_idx", ["j"])
    path = F.coalesce(F.col("path_id").cast("string"), F.col("id").cast("string"))
    rows = rows.withColumn("path_id", path).drop("id")
    rows = rows.withColumn("instr_id", F.concat_ws("_", F.lit("reverie"), "path_id", F.col("objid").cast("string"), "j"))
    joined = rows.join(viewpoints.withColumn("_found", F.lit(True)), ["scan", "objid"], "left")
    fine = F.col("objid").isNull() | F.col("_found").isNotNull()
    missing = F.raise_error(F.concat(F.lit("no viewpoint shows object "), F.col("objid").cast("string")))
    return joined.withColumn("instr_id", F.when(fine, F.col("instr_id")).otherwise(missing)).drop("_found").withColumn("data_type", F.lit("reverie"))


def last_of_key(entries: str, key: str) -> Column:
    """An array of structs as a map by ``key``; of equal keys the last stays."""
    own = F.filter(entries, lambda e, k: ~F.exists(F.slice(entries, k + 2, F.size(entries)), lambda later: later[key] == e[key]))
    return F.map_from_entries(F.transform(own, lambda e: F.struct(e[key], e)))


def unit_angles(point: Column) -> Column:
    """A struct (heading, elevation) as shares of a full turn."""
    return F.struct((point["heading"] / FULL).alias("heading"), ((point["elevation"] + math.pi) / FULL).alias("elevation"))


def unit_boxes(boxes: str) -> Column:
    """Boxes (vp, center, corners) with all angles as shares of a full turn, and the centre's beside."""
    return F.transform(boxes, lambda b: F.struct(
        b["vp"].alias("vp"), (b["center"]["heading"] / FULL).alias("heading"), ((b["center"]["elevation"] + math.pi) / FULL).alias("elevation"),
        F.transform(b["corners"], unit_angles).alias("corners"),
    ))


def search_rows(df: DataFrame, longest: int = 100) -> DataFrame:
    """Object-search records: (raw_idx, path_id, scan, path, instructions array<struct<full>>, instr_encodings, bboxes)."""
    rows = numbered(by_instruction(df), "raw_idx", ["j"])
    rows = rows.withColumn("instr_id", F.concat_ws("_", F.lit("soon"), "raw_idx", "path_id", "j")).withColumn("instruction", F.col("instruction.full"))
    rows = rows.withColumn("instr_encoding", F.slice(F.get("instr_encodings", F.col("j"))["full"], 1, longest)).drop("instr_encodings")
    rows = rows.withColumn("end_image_ids", F.col("bboxes.image_id")).withColumn("bboxes", last_of_key("bboxes", "image_id"))
    labels = F.transform_values("bboxes", lambda _, b: b["pseudo_label"])
    return rows.withColumn("image_id_to_obj_label", labels).withColumn("heading", F.lit(0.0)).withColumn("data_type", F.lit("soon"))


def dialog_text(target: Column, history: str) -> Column:
    """A dialog as one instruction: what the goal holds, then questions and answers, each ending in ``?`` or ``.``."""

    def line(turn: Column) -> Column:
        said = F.when(F.substring(turn["message"], -1, 1).isin("?", "."), turn["message"]).otherwise(F.concat(turn["message"], F.lit(".")))
        who = F.when(turn["role"] == "navigator", "Question: ").when(turn["role"] == "oracle", "Answer: ").otherwise(F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(turn["role"], F.lit("null")))))
        return F.concat(who, said, F.lit("\n"))

    turns = F.array_join(F.transform(history, line), "")
    return F.regexp_replace(F.concat(F.lit("The goal room contains a "), target, F.lit(".\n"), turns), r"\n\z", "")


def dialog_rows(df: DataFrame, longest: int = 128) -> DataFrame:
    """Dialog records: (raw_idx, inst_idx, target, start_pano, planner_path, dialog_history): text, path and id."""
    rows = numbered(df, "raw_idx", [])
    rows = rows.withColumn("instr_id", F.concat_ws("_", F.lit("cvdn"), "sample_idx", "inst_idx"))
    rows = rows.withColumn("path", F.coalesce("planner_path", F.array("start_pano")))
    text = dialog_text(F.col("target"), "dialog_history")
    return rows.withColumn("_text", text).withColumn("instruction", first_words("_text", longest)).drop("_text", "dialog_history").withColumn("data_type", F.lit("cvdn"))


def question_rows(df: DataFrame) -> DataFrame:
    """Scenes (scene_id, image_info, annotation): one row per question, answers in lower case."""
    r = df.select("scene_id", "image_info", F.explode("annotation").alias("a"))
    return r.select("scene_id", "image_info", "a.question_id", "a.question", F.transform("a.answers", lambda x: F.lower(x)).alias("answers"))


def turn_pair_rows(df: DataFrame) -> DataFrame:
    """Image conversations (id, image, conversations): exactly a human's and a model's turn, or an error."""
    first, second = F.get("conversations", F.lit(0)), F.get("conversations", F.lit(1))
    ok = (F.size("conversations") == 2) & (first["from"] == "human") & (second["from"] == "gpt")
    asked = stripped(F.replace(first["value"], F.lit("<image>"), F.lit("")))
    checked = F.when(F.coalesce(ok, F.lit(False)), asked).otherwise(F.raise_error(F.concat(F.lit("not a human's and a model's turn: "), F.col("id").cast("string"))))
    return df.select("id", F.split("image", r"\.")[0].alias("image_id"), checked.alias("question"), F.array(second["value"]).alias("answers"))


CAPTION_QUESTION = "What is the caption of this image?"  # a fixed value


def caption_rows(df: DataFrame, training: bool) -> DataFrame:
    """Captions (imgid, filename, sentences): one row per sentence to learn from, or per image with all of them."""
    image = F.element_at(F.split("filename", "_"), -1).alias("image")
    if training:
        r = df.select(image, F.explode("sentences").alias("s"))
        return r.select("s.sentid", "image", F.lit(CAPTION_QUESTION).alias("input"), F.concat("s.raw", F.lit("</s>")).alias("label"))
    return df.select("imgid", image, F.lit(CAPTION_QUESTION).alias("input"), F.col("sentences.raw").alias("refs"))


def scenes(questions: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions by scene with the scene's images in the order of their numbers; and how many questions no scene has.

    questions: (scene_id, question_id, question, answers); images: (scene_id, image_id, pose).
    """
    info = images.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct(F.col("image_id").cast("int").alias("n"), "image_id", "pose"))).alias("i"))
    info = info.select("scene_id", F.transform("i", lambda x: F.struct(x["image_id"].alias("image_id"), x["pose"].alias("pose"))).alias("image_info"))
    ann = questions.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("question_id", "question", F.coalesce("answers", F.array().cast("array<string>")).alias("answers")))).alias("annotation"))
    lost = questions.join(info.select("scene_id"), "scene_id", "left_anti").agg(F.count(F.lit(1)).alias("not_exist"))
    return ann.join(info, "scene_id"), lost


def object_records(df: DataFrame, arrays: list[str]) -> DataFrame:
    """(key.., row, fields..) of parallel arrays: as many rows as the first has; shorter ones end in nulls."""
    n = F.size(arrays[0])
    zipped = F.slice(F.arrays_zip(*arrays), 1, n)
    keys = [c for c in df.columns if c not in arrays]
    r = df.where(n > 0).select(*keys, F.posexplode(zipped).alias("row", "o"))
    return r.select(*keys, "row", *(F.col("o")[a].alias(a) for a in arrays))


def resampled_end(df: DataFrame, seed: int) -> DataFrame:
    """Another of the end viewpoints for training, chosen by a hash of id and seed, as the new goal ``end_vp``."""
    n = F.size("end_vps")
    k = F.pmod(F.xxhash64("instr_id", F.lit(seed)), n) + 1
    return df.withColumn("end_vp", F.when(n > 0, F.try_element_at("end_vps", k.cast("int"))))
