"""What an agent sees: samples and observations put together from annotations, graph and feature stores.

Items: (instr_id, scan, vp, heading, elevation) and whatever else goes along. Stores: (scan, vp, views
array<array<double>>), a vector for each of the 36 views. Everything is look-ups by key and column
expressions; a viewpoint's neighbours are its only list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions import geometry as G
from trailweave.functions.arrays import first_words
from trailweave.operators import graph, sampling
from trailweave.sources.annotations import features

ANGLES = 4


def view_at(heading: Column, elevation: Column) -> Column:
    """The number of the view that a viewer looks into."""
    ring = F.least(F.greatest(F.round(elevation / G.STEP).cast("int") + 1, F.lit(0)), F.lit(2))
    return ring * G.RING + F.pmod(F.round(heading / G.STEP).cast("int"), F.lit(G.RING))


#: Where a search looks at its start in evaluation; words of a dialog.
SEARCH_HEADING = 1.52
DIALOG_WORDS = 128


def search_items(rows: DataFrame, edges: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Object-search records (instr_id, scan, path, end_image_ids) as items: ``vp``, ``heading``, ``elevation``, ``gt_path``.

    In training (``edges`` given) an agent looks anywhere and is led along a shortest way to one of the end viewpoints;
    both are drawn by hashes of id and seed. A goal that can't be reached leaves no way: null. In evaluation the path stays.
    """
    start = rows.withColumn("vp", F.col("path")[0]).withColumn("elevation", F.lit(0.0))
    if edges is None:
        return start.withColumn("heading", F.lit(SEARCH_HEADING)).withColumnRenamed("path", "gt_path")
    n = F.size("end_image_ids")
    end = F.get("end_image_ids", F.floor(sampling.unit(seed, "instr_id") * n).cast("int"))
    drawn = start.withColumn("end_vp", end).withColumn("heading", sampling.unit(seed + 1, "instr_id") * G.FULL)
    asked = drawn.select("scan", F.col("vp").alias("src"), F.col("end_vp").alias("dst"))
    ways = graph.asked_paths(edges, asked).select("scan", F.col("src").alias("vp"), F.col("dst").alias("end_vp"), F.col("path").alias("gt_path"))
    return drawn.drop("path").join(ways, ["scan", "vp", "end_vp"], "left")


def dialog_items(rows: DataFrame) -> DataFrame:
    """Dialog records (path, start_heading, instruction) as items: they look where the dialog began, and say 128 words at most."""
    return rows.select(
        *(c for c in rows.columns if c not in ("path", "start_heading", "instruction")), F.col("path")[0].alias("vp"), F.col("path").alias("gt_path"),
        F.col("start_heading").alias("heading"), F.lit(0.0).alias("elevation"), first_words("instruction", DIALOG_WORDS).alias("instruction"),
    )


def relative_views(viewpoints: DataFrame) -> DataFrame:
    """Rows with ``base`` (a view) and, for each of all views, its angles off that one: a join with the table of 36 x 36 pairs."""
    v = viewpoints.sparkSession.range(G.VIEWS).select(F.col("id").cast("int").alias("base"))
    pairs = v.crossJoin(v.withColumnRenamed("base", "view"))  # 1296 rows
    f = G.angle_feature(G.view_heading(F.col("view")) - G.view_heading(F.col("base")), G.view_elevation(F.col("view")) - G.view_elevation(F.col("base")))
    return viewpoints.join(F.broadcast(pairs.withColumn("angles", f)), "base")


def candidate_lists(best: DataFrame, nodes: DataFrame) -> DataFrame:
    """(scan, vp, candidates): the neighbours of every viewpoint with their views, angles and positions."""
    place = nodes.select("scan", F.col("vp").alias("nbr"), F.struct("x", "y", "z").alias("position"))
    one = F.struct("nbr", "view", "heading", "elevation", "position")
    return best.join(place, ["scan", "nbr"]).groupBy("scan", "vp").agg(F.array_sort(F.collect_list(one)).alias("candidates"))


def observed(items: DataFrame, nodes: DataFrame, candidates: DataFrame, store: DataFrame, size: int) -> DataFrame:
    """Items with ``view_index``, ``position``, ``feature`` (per view: its vector and angles) and ``candidate``.

    Angles are relative to the view the agent looks into; a candidate has the vector of the view it is in.
    They come out alike however often a viewpoint is seen. A viewpoint that the store lacks raises.
    """
    place = nodes.select("scan", "vp", F.struct("x", "y", "z").alias("position"))
    at = items.withColumn("view_index", view_at(F.col("heading"), F.col("elevation"))).join(place, ["scan", "vp"])
    at = features(store, at.join(candidates, ["scan", "vp"], "left"), ["scan", "vp"], G.VIEWS, "views")
    base = (G.view_heading(F.col("view_index")), G.view_elevation(F.col("view_index")))

    def seen(vector: Column, heading: Column, elevation: Column) -> Column:
        return F.concat(F.slice(vector, 1, size), G.angle_feature(heading - base[0], elevation - base[1], ANGLES))

    whole = F.transform("views", lambda v, k: seen(v, G.view_heading(k), G.view_elevation(k)))
    own = F.transform("candidates", lambda c: F.struct(
        c["nbr"].alias("nbr"), c["view"].alias("view"), (c["heading"] - base[0]).alias("heading"), (c["elevation"] - base[1]).alias("elevation"),
        c["position"].alias("position"), seen(F.get("views", c["view"]), c["heading"], c["elevation"]).alias("feature"),
    ))
    made = at.withColumn("feature", whole).withColumn("candidate", own)
    kind = made.schema["candidate"].dataType
    return made.withColumn("candidate", F.coalesce("candidate", F.array().cast(kind))).drop("views", "candidates")


#: Fields of an observation; the fine-grained ones only where the items have them.
FIELDS = ("instr_id", "scan", "vp", "view_index", "position", "heading", "elevation", "feature", "candidate", "instruction", "gt_path", "path_id")
FINE = ("fg_instruction", "fg_view")


def samples(rows: DataFrame) -> DataFrame:
    """(sample_idx, instr_id, data_type, observations): what ``observed`` made of numbered items, as one struct each; ``distance`` is 0."""
    fields = [*FIELDS, *(f for f in FINE if f in rows.columns)]
    return rows.select("sample_idx", "instr_id", "data_type", F.struct(*fields, F.lit(0).alias("distance")).alias("observations"))


def view_arrays(rows: DataFrame, size: int, objects: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Observations with ``view_img_fts``, ``loc_fts``, ``nav_types``, ``view_lens`` and ``cand_vpids``: candidates' views first, then those none uses.

    ``objects``: (scan, vp, objects array<struct<obj_id, ft, heading, elevation, box>>); then also ``obj_ids``,
    ``obj_img_fts``, ``obj_loc_fts`` and ``obj_lens``, ``most`` at most, none where the store has no such viewpoint.
    """
    used = F.transform("candidate", lambda c: c["view"])
    free = F.filter(F.sequence(F.lit(0), F.lit(G.VIEWS - 1)), lambda v: ~F.array_contains(used, v))
    every = F.concat(F.transform("candidate", lambda c: c["feature"]), F.transform(free, lambda v: F.get("feature", v)))
    box = F.array(*(F.lit(1.0),) * 3)
    made = rows.withColumn("_every", every).select(
        *rows.columns,
        F.transform("_every", lambda f: F.slice(f, 1, size)).alias("view_img_fts"),
        F.transform("_every", lambda f: F.concat(F.slice(f, size + 1, ANGLES), box)).alias("loc_fts"),
        F.concat(F.array_repeat(F.lit(1), F.size(used)), F.array_repeat(F.lit(0), F.size(free))).alias("nav_types"),
        F.size("_every").alias("view_lens"), F.transform("candidate", lambda c: c["nbr"]).alias("cand_vpids"),
    )
    if objects is None:
        return made
    joined = made.join(objects.select("scan", "vp", "objects"), ["scan", "vp"], "left")
    held = F.coalesce("objects", F.array().cast(objects.schema["objects"].dataType))
    joined = joined.withColumn("objects", F.slice(held, 1, most) if most else held)
    base = (G.view_heading(F.col("view_index")), G.view_elevation(F.col("view_index")))
    place = lambda o: F.concat(G.angle_feature(o["heading"] - base[0], o["elevation"] - base[1], ANGLES), G.box_feature_xyxy(o["box"]))
    return joined.select(
        *made.columns, F.col("objects.obj_id").alias("obj_ids"), F.col("objects.ft").alias("obj_img_fts"),
        F.transform("objects", place).alias("obj_loc_fts"), F.size("objects").alias("obj_lens"),
    )


def last_visits(steps: DataFrame, order: list[str]) -> DataFrame:
    """(scan, vp, order..) of each viewpoint's last visit, found before anything that a visit sees is joined to it."""
    return steps.groupBy("scan", "vp").agg(F.max(F.struct(*order)).alias("o")).select("scan", "vp", "o.*")


def cached_candidates(observations: DataFrame, order: list[str]) -> DataFrame:
    """(scan, vp, nbr, view): the view last written for each neighbour of a viewpoint; observations: (scan, vp, candidate, order..)."""
    each = observations.select("scan", "vp", *order, F.explode("candidate").alias("c"))
    return each.groupBy("scan", "vp", "c.nbr").agg(F.max_by("c.view", F.struct(*order)).alias("view"))


def missing_edges(paths: DataFrame, edges: DataFrame, key: str = "instr_id") -> DataFrame:
    """(key, scan, pos, prev, node): the moves of paths (key, scan, pos, node) along no edge; staying is a move along none but fine."""
    before = Window.partitionBy(key).orderBy("pos")
    moves = paths.select(key, "scan", "pos", F.lag("node").over(before).alias("prev"), "node").where("prev <> node")
    return moves.join(edges.select("scan", F.col("src").alias("prev"), F.col("dst").alias("node")), ["scan", "prev", "node"], "left_anti").select(key, "scan", "pos", "prev", "node")


def object_truth(rows: DataFrame) -> DataFrame:
    """(instr_id, scan, path, objid) of the annotations that name an object: the ground truth of grounding."""
    return rows.where(F.col("objid").isNotNull()).select("instr_id", "scan", "path", "objid")


# ---- parameters of models, as rows (name, values or numbers) ---------------------------------------


def first_nonfinite(parameters: DataFrame, values: str = "values", most: int = 20) -> DataFrame:
    """(name) of the first parameters, by their order, with a number that is not finite."""
    bad = F.exists(values, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    return parameters.where(bad).orderBy("position").limit(most).select("position", "name")


def checked_finite(parameters: DataFrame, values: str = "values") -> DataFrame:
    """The parameters; reading one with a number that is not finite raises."""
    bad = F.exists(values, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    message = F.concat(F.lit("not finite: "), F.col("name"))
    return parameters.withColumn(values, F.when(~F.coalesce(bad, F.lit(False)), F.col(values)).otherwise(F.raise_error(message)))


# Marks of adapter parameters, and the part of a model in which they count for themselves.
ADAPTER_MARKS = ("lora_", "lora_a", "lora_b", "lora_magnitude", "magnitude_vector")
LANGUAGE_PART = "lang_model."


def parameter_groups(parameters: DataFrame) -> DataFrame:
    """(group, n_tensors, n_numbers), sorted: parameters (name, size) by the model's parts, adapters of the language part for themselves."""
    low = F.lower("name")
    adapter = F.lit(False)
    for mark in ADAPTER_MARKS:
        adapter = adapter | F.contains(low, F.lit(mark))
    of = F.when(~F.startswith("name", F.lit(LANGUAGE_PART)), F.split("name", r"\.")[0]).when(adapter, LANGUAGE_PART + "adapter").otherwise(LANGUAGE_PART + "non_adapter")
    return parameters.groupBy(of.alias("group")).agg(F.count(F.lit(1)).alias("n_tensors"), F.sum("size").alias("n_numbers")).orderBy("group")


def extracted(rows: DataFrame, model, columns: list[str], out: str) -> DataFrame:
    """Features by a model that works on batches: ``model`` takes a frame of ``columns`` and gives one of ``out``'s further fields.

    ``out`` is the schema of the result; its fields that rows have are passed through. The batch size is the
    session's Arrow batch size; a model is loaded once per task if ``model`` is a function that returns one.
    """

    def run(parts):
        ready = model()
        for pdf in parts:
            yield pdf.assign(**ready(pdf[columns]))[names]

    names = [f.split()[0] for f in out.split(", ")]
    return rows.mapInPandas(run, out)
