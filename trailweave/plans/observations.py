"""Observation, sample, parameter, store and file queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.functions import arrays, geometry
from trailweave.operators import annotate, candidates as C, graph, memory, meteor, observations as O, registry as tasks, sampling, textmetrics
from trailweave.plans import navigation, text
from trailweave.plans.agents import VIEWS_OF
from trailweave.plans.base_sql import DIST, NODES, PICKS, STEPS, WALKED, words_sql
from trailweave.sources import annotations, catalog, sinks, views
from trailweave.sources.durable import durable, shared_folder
from trailweave.sources.spread import spread
from trailweave.sources.tables import table
from trailweave.streaming import memory as stream
from trailweave.streaming.topology import keyed_maps

#: Numbers of a view's vector.
SIZE = 8


def _store(spark: SparkSession, sf: str) -> DataFrame:
    """(scan, vp, views): 36 vectors of each viewpoint, the k-th being the embedding's first numbers times k / 36."""
    first = F.transform(F.slice("embedding", 1, SIZE), lambda x: x.cast("double"))
    each = F.transform(F.sequence(F.lit(1), F.lit(geometry.VIEWS)), lambda k: F.transform("f", lambda x: x * k / geometry.VIEWS))
    return table(spark, sf, "embeddings").select(views.scan().alias("scan"), F.col("vec_id").alias("vp"), first.alias("f")).select("scan", "vp", each.alias("views"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """Trajectories as annotations: an agent at the start, looking about by user and week."""
    p = views.predictions(spark, sf).withColumn("gt_path", F.flatten("trajectory"))
    return p.select(
        "instr_id", "user_id", "scan", F.col("gt_path")[0].alias("vp"), ((F.col("user_id") % 12) / 2.0).alias("heading"), F.lit(0.0).alias("elevation"),
        F.concat(F.lit("go to "), F.col("goal").cast("string")).alias("instruction"), "gt_path", "week", F.concat_ws("_", "user_id", "week").alias("path_id"), F.lit("r2r").alias("data_type"),
    )


def _observed(spark: SparkSession, sf: str, items: DataFrame | None = None) -> DataFrame:
    n = views.nodes(spark, sf)
    lists = O.candidate_lists(C.best_views(n, views.edges(spark, sf)), n)
    return O.observed(_items(spark, sf) if items is None else items, n, lists, _store(spark, sf), SIZE)


def _total(numbers: str | Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)


def obs11_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples: each trajectory's item with its first observation, features of all views and of the neighbours."""
    s = O.samples(_observed(spark, sf, annotate.numbered(durable(_items(spark, sf)), "user_id", ["week"])))
    ob = F.col("observations")
    return s.select(
        "sample_idx", "instr_id", ob["view_index"].alias("view_index"), F.size(ob["candidate"]).alias("n_candidates"), F.size(ob["feature"]).alias("n_views"),
        F.round(_total(F.flatten(ob["feature"])), 5).alias("feature_sum"), F.round(_total(F.flatten(ob["candidate"]["feature"])), 5).alias("candidate_sum"),
        F.round(ob["position"]["x"] + 2 * ob["position"]["y"] + 3 * ob["position"]["z"], 6).alias("place"), F.size(ob["gt_path"]).alias("n_path"),
    )


def obs11_search_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of object search in training: a hashed direction, and a shortest way to one of the scan's first three viewpoints."""
    e = durable(views.edges(spark, sf))
    picks = durable(views.picks(spark, sf, graph.reached(e, views.nodes(spark, sf))))
    ends = picks.where("k < 3").groupBy("scan").agg(F.array_sort(F.collect_list("vp")).alias("end_image_ids"))
    p = views.predictions(spark, sf, picks).join(ends, "scan")
    rows = p.select("instr_id", "user_id", "week", "scan", F.flatten("trajectory").alias("path"), "end_image_ids", F.lit("find it").alias("instruction"), F.concat_ws("_", "user_id", "week").alias("path_id"), F.lit("soon").alias("data_type"))
    items = annotate.numbered(durable(O.search_items(rows, e, 23)), "user_id", ["week"])
    s = O.samples(_observed(spark, sf, items))
    ob = F.col("observations")
    return s.select("sample_idx", "instr_id", ob["view_index"].alias("view_index"), F.element_at(ob["gt_path"], -1).alias("goal"), F.size(ob["gt_path"]).cast("long").alias("n_path"), F.md5(F.array_join(F.transform(ob["gt_path"], lambda v: v.cast("string")), ">")).alias("path_md5"), F.size(ob["feature"]).alias("n_views"), "data_type")


def obs11_dialog_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of dialog navigation: a dialog for every conversation, from where its scan's first viewpoints are."""
    e = durable(views.edges(spark, sf))
    picks = durable(views.picks(spark, sf, graph.reached(e, views.nodes(spark, sf))))
    first = picks.where("k = 0").select("scan", F.col("vp").alias("start"))
    n = first.agg(F.count(F.lit(1)).alias("scans"))  # one row
    placed = first.select("start", "scan", (F.row_number().over(Window.orderBy("scan")) - 1).alias("place"))  # a row a scan
    d = views.dialogs(spark, sf).crossJoin(F.broadcast(n)).withColumn("place", F.col("conv_id") % F.col("scans")).join(placed, "place")
    rows = d.select(
        F.concat_ws("_", F.lit("cvdn"), "conv_id").alias("instr_id"), "conv_id", "scan", F.array("start").alias("path"), ((F.col("conv_id") % 12) / 2.0).alias("start_heading"),
        annotate.dialog_text(F.col("target"), "dialog_history").alias("instruction"), F.col("conv_id").alias("path_id"), F.lit("cvdn").alias("data_type"),
    )
    s = O.samples(_observed(spark, sf, annotate.numbered(O.dialog_items(rows), "conv_id", [])))
    ob = F.col("observations")
    return s.select("sample_idx", "instr_id", ob["vp"].alias("vp"), ob["view_index"].alias("view_index"), F.md5(ob["instruction"]).alias("instruction_md5"), F.size(ob["gt_path"]).alias("n_path"), "data_type")


def mth12_relative_views(spark: SparkSession, sf: str) -> DataFrame:
    """Every viewpoint's views by their angles off the one it looks into: sums over the 36, weighed by their numbers."""
    r = O.relative_views(views.nodes(spark, sf).select("scan", "vp", (F.col("vp") % 36).cast("int").alias("base")))
    return r.groupBy("scan", "vp").agg(*(F.round(F.sum(F.col("angles")[k] * (F.col("view") + 1)), 5).alias(f"f{k}") for k in range(4)), F.count(F.lit(1)).alias("n"))


def txt09_scene_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """The bundle of scene questions: all scores with METEOR, times 100."""
    p = durable(spread(text.pairs(spark, sf), "id"))  # read by every score
    m = meteor.corpus(meteor.best(meteor.counts(p))).select(F.lit("meteor").alias("metric"), (F.col("meteor") * 100).alias("value"))
    return textmetrics.bundle(p).unionByName(m).select("metric", F.round("value", 3).alias("value"))


def obs02_views_with_objects(spark: SparkSession, sf: str) -> DataFrame:
    """View lists of the first observations, candidates' views first, with the objects in sight (every third viewpoint has some)."""
    e = table(spark, sf, "embeddings").where("vec_id % 3 = 0")
    one = lambda k: F.struct(
        (F.col("vec_id") * 10 + k).alias("obj_id"), F.array(F.col("embedding")[0].cast("double") * k).alias("ft"), (F.col("vec_id") % 7 + k).cast("double").alias("heading"),
        (k / F.lit(4.0)).alias("elevation"), F.array(F.lit(0.0), F.lit(0.0), k * 10.0, k * 20.0).alias("box"),
    )
    o = e.select(views.scan().alias("scan"), F.col("vec_id").alias("vp"), F.transform(F.sequence(F.lit(1), (F.col("vec_id") % 5 + 1).cast("int")), one).alias("objects"))
    a = O.view_arrays(_observed(spark, sf), SIZE, o, 3)
    return a.select(
        "instr_id", "view_lens", "obj_lens", F.array_join(F.transform("nav_types", lambda x: x.cast("string")), "").alias("nav_types"),
        F.array_join(F.transform("cand_vpids", lambda x: x.cast("string")), ",").alias("cand_vpids"), F.round(_total(F.flatten("view_img_fts")), 5).alias("img_sum"),
        F.round(_total(F.flatten("loc_fts")), 5).alias("loc_sum"), F.array_join(F.transform("obj_ids", lambda x: x.cast("string")), ",").alias("obj_ids"),
        F.round(_total(F.flatten("obj_loc_fts")), 6).alias("obj_loc_sum"),
    )


def st04_candidate_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Views of all neighbours of the viewpoints that were visited, the last written counts; a later visit may have moved them."""
    s = views.steps(spark, sf)
    b = C.best_views(views.nodes(spark, sf), views.edges(spark, sf))
    near = b.groupBy("scan", "vp").agg(F.array_sort(F.collect_list(F.struct("nbr", "view"))).alias("c"))
    # a visit writes all neighbours of its viewpoint, so earlier ones than the last are overwritten as a whole
    last = O.last_visits(s.withColumnRenamed("node", "vp"), ["week", "pos", "user_id"])
    seen = last.join(near, ["scan", "vp"])
    moved = F.transform("c", lambda c: F.struct(c["nbr"].alias("nbr"), ((c["view"] + F.col("pos")) % 36).alias("view")))
    return O.cached_candidates(seen.withColumn("candidate", moved), ["week", "pos", "user_id"])


def trj15_missing_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Moves of the trajectories along no edge of the graph: a report, not an error."""
    return O.missing_edges(views.steps(spark, sf), views.edges(spark, sf)).select("instr_id", "pos", "prev", "node")


def flt02_object_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations that name an object are ground truth."""
    i = _items(spark, sf).withColumn("objid", F.when(F.col("user_id") % 3 != 0, F.col("user_id")))
    return O.object_truth(i.withColumnRenamed("gt_path", "path")).select("instr_id", "scan", F.size("path").alias("n"), "objid")


def flt11_valid_options(spark: SparkSession, sf: str) -> DataFrame:
    """Options that can be chosen, and scores where none can: stopping alone is left."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    own = F.transform("s", lambda _, k: k < F.col("vec_id") % 9)
    visited = F.transform("s", lambda _, k: F.col("vec_id") % 4 == 0)
    e = e.withColumn("valid", C.valid_options(own, visited)).withColumn("ended", F.col("vec_id") % 5 == 0)
    fixed = C.forced_stop(F.col("s"), F.col("valid"), F.col("ended"))
    return e.select("vec_id", F.size(F.filter("valid", lambda v: v)).alias("n_valid"), C.mask_size(F.col("valid")).alias("divisor"), F.round(fixed[0], 6).alias("stop"), (fixed[1] < -1e30).alias("forced"))


def flt12_nonfinite(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty parameters with a number that is not finite."""
    bad = F.when(F.col("vec_id") % 7 == 3, F.array(F.lit(float("nan")))).when(F.col("vec_id") % 11 == 5, F.array(F.lit(float("-inf")))).otherwise(F.array(F.lit(1.0)))
    p = table(spark, sf, "embeddings").select(F.col("vec_id").alias("position"), F.concat(F.lit("layer."), F.col("vec_id").cast("string")).alias("name"), F.concat(F.transform("embedding", lambda x: x.cast("double")), bad).alias("values"))
    return O.first_nonfinite(p)


_PARTS = ("lang_model.q.lora_a", "lang_model.q", "vision.block", "projector", "lang_model.LoRA_magnitude", "embed.table")


def agg17_parameter_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of parameters by the model's parts, sorted."""
    part = F.element_at(F.array(*(F.lit(x) for x in _PARTS)), (F.col("p_partkey") % len(_PARTS) + 1).cast("int"))
    p = table(spark, sf, "part").select(F.concat_ws(".", part, F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").cast("long").alias("size"))
    return O.parameter_groups(p)


def _norms():
    return lambda pdf: {"norm": pdf["v"].map(lambda v: float(sum(x * x for x in v) ** 0.5)), "most": pdf["v"].map(max)}


def udf04_extracted(spark: SparkSession, sf: str) -> DataFrame:
    """Features by a model over batches: here each embedding's length and greatest number."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return O.extracted(e, _norms, ["v"], "vec_id long, norm double, most double").select("vec_id", F.round("norm", 6).alias("norm"), F.round("most", 6).alias("most"))


def txt13_left(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' word lengths cut on the left to 1024 and padded on the left to the longest of their batch of 32."""
    ids = F.transform(arrays.words(F.coalesce("text", F.lit(""))), lambda w: F.length(w))
    d = annotate.numbered(table(spark, sf, "documents").select("doc_id", ids.alias("ids")), "doc_id", [])
    d = d.withColumn("ids", arrays.last_tokens(F.col("ids"), 1024)).withColumn("batch", F.floor(F.col("sample_idx") / 32))
    d = d.withColumn("most", F.max(F.size("ids")).over(Window.partitionBy("batch")))
    made = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ","))
    return d.select("doc_id", "batch", "most", F.size("ids").alias("n"), made(arrays.padded(F.col("ids"), F.col("most"), F.lit(0), True)).alias("ids_md5"), made(arrays.length_mask(F.col("ids"), F.col("most"), True)).alias("mask_md5"))


def txt10_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths and their ratio, of all pairs and by the reference's option; then with other hypotheses for the same references."""
    p = text.pairs(spark, sf)
    again = p.withColumn("hyp", F.col("refs")[0])
    out = [textmetrics.lengths(textmetrics.bleu_counts(d, o)).select(F.lit(k).alias("hypotheses"), F.lit(o).alias("option"), "testlen", F.round("reflen", 6).alias("reflen"), F.round("ratio", 6).alias("ratio")) for k, d in (("own", p), ("other", again)) for o in ("closest", "shortest", "average")]
    made = out[0]
    for o in out[1:]:
        made = made.unionByName(o)
    return made


def txt11_captions(spark: SparkSession, sf: str) -> DataFrame:
    """The caption bundle: BLEU alone, not in percent."""
    return textmetrics.caption_bundle(text.pairs(spark, sf)).select("metric", F.round("value", 6).alias("value"))


def str06_without_punctuation(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens between spaces in lower case, without those that are punctuation."""
    t = table(spark, sf, "conversations")
    spread = F.regexp_replace(F.lower("text"), r"([.,!?;:])", " $1 ")
    return t.select("conv_id", "turn", F.md5(F.array_join(arrays.without_punctuation(arrays.words(spread)), " ")).alias("md5"))


def st07_jumps(spark: SparkSession, sf: str) -> DataFrame:
    """Expert walks that may jump to any known viewpoint, until they arrive: in all as long as the shortest way."""
    p = views.predictions(spark, sf)
    s = p.select("instr_id", "scan", F.flatten("trajectory")[0].alias("start"), "goal")
    made = memory.jump_rollout(s, views.edges(spark, sf), 100)
    return made.select("instr_id", "cur", "arrived", F.round("moved", 6).alias("moved"))


def st08_expert_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The action of an expert who follows the annotated path, at each of its steps; options are stopping and the path's viewpoints in order."""
    p = views.predictions(spark, sf).select("instr_id", F.flatten("trajectory").alias("path"))
    p = p.withColumn("options", F.concat(F.array(F.lit(None).cast("long")), F.array_sort(F.array_distinct("path"))))
    each = p.select("instr_id", "path", "options", F.posexplode("path").alias("pos", "node"))
    return each.select("instr_id", F.col("pos").cast("long").alias("pos"), C.expert_step(F.col("path"), F.col("pos"), F.col("options")).alias("action"))


def st01_stream_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The graph memory of each trajectory as stream state: steps come in three parts, after each the stream goes on from its checkpoint."""
    s = durable(views.steps(spark, sf).select("instr_id", "pos", "scan", "node"))
    e = durable(views.edges(spark, sf))
    folder = shared_folder(spark)
    third = F.when(F.col("pos") < 2, 0).when(F.col("pos") < 5, 1).otherwise(2)
    with keyed_maps(spark):
        for k in range(3):
            seen = memory.observed(s.where(third == k), e)  # a step's neighbours are written once
            seen.write.mode("append").parquet(f"{folder}/seen")
            source = spark.readStream.schema(seen.schema).parquet(f"{folder}/seen")
            out = stream.drained(spark, stream.graph_memory(source), f"{folder}/run", "update", stream.GRAPH_OUT)
    last = out.groupBy("instr_id").agg(F.max_by(F.struct("n_known", "n_visited"), "batch").alias("s"))
    return last.select("instr_id", "s.n_known", "s.n_visited")


def src09_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Tasks' feature stores by name: two stores are written, each task is led to its own and looks up a few viewpoints."""
    folder = shared_folder(spark)
    for name, k in (("mp3d", 1), ("coco", 2)):
        table(spark, sf, "embeddings").select("vec_id", (F.col("embedding")[0].cast("double") * k).alias("f")).write.parquet(f"{folder}/{name}")
    stores = catalog.Catalog(spark, {"mp3d": f"{folder}/mp3d", "coco": "coco"}, folder)
    objects = catalog.object_catalog(spark, {"reverie": "mp3d", "nothing": "coco"}, folder)
    made = [
        (stores if kind == "features" else objects).store(name).agg(F.round(F.sum("f"), 4).alias("total"), F.count(F.lit(1)).alias("n")).select(F.lit(task).alias("task"), F.lit(kind).alias("kind"), F.lit(name).alias("store"), "total", "n")
        for task in ("r2r", "reverie", "llava") for kind in ("features", "objects") for name in [getattr(tasks.load(task), kind)] if name and (kind == "features" or name in objects)
    ]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def snk08_aligned_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features and metadata written as two tables and met again by their row."""
    folder = shared_folder(spark)
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("ft"))
    sinks.write_features(e, folder, ["ft"], ["vec_id"])
    meta = spark.read.schema("vec_id long, label int, row long").json(f"{folder}/metadata")
    back = meta.join(spark.read.parquet(f"{folder}/features").withColumnRenamed("vec_id", "v"), "row")
    return back.select("vec_id", "label", (F.col("vec_id") == F.col("v")).alias("aligned"), F.round(_total("ft"), 6).alias("total"))


def snk05_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with their own scores written as JSON lines and read back."""
    folder = shared_folder(spark)
    p = text.pairs(spark, sf)
    made = sinks.answer_file(p.select(F.col("id").alias("instr_id"), F.col("hyp").alias("answer")), textmetrics.exact_match(p).withColumnRenamed("id", "instr_id"))
    sinks.write_json(made, folder)
    return spark.read.schema("instr_id long, answer string, em double").json(folder).select("instr_id", F.md5("answer").alias("answer_md5"), "em")


def set02_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Results of two ranks put together, nothing removed: an id that both had counts twice."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    ranks = d.where("doc_id % 2 = 0").union(d.where("doc_id % 3 = 0"))
    return ranks.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def set06_paired(spark: SparkSession, sf: str) -> DataFrame:
    """Hypotheses and references by id; an id that only one side has would raise."""
    p = text.pairs(spark, sf)
    m = textmetrics.paired(p.select("id", "hyp"), p.select("id", "refs"))
    return m.select("id", F.md5("hyp").alias("hyp_md5"), F.size("refs").alias("n_refs"))


def prj21_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes that are no UTF-8 become the replacement character."""
    raw = F.concat(F.unhex(F.lit("FF")), F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("C3")))
    return table(spark, sf, "documents").select("doc_id", F.md5(catalog.as_text(raw)).alias("md5"))


def obs12_image_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Image samples: features looked up by the image alone."""
    store = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("image_id"), F.transform("embedding", lambda x: x.cast("double")).alias("ft"))
    wanted = table(spark, sf, "conversations").where("role = 'user'").crossJoin(F.broadcast(table(spark, sf, "embeddings").agg((F.max("vec_id") + 1).alias("n"))))  # one row
    w = wanted.select("conv_id", "turn", F.col("text").alias("question"), (F.col("conv_id") % F.col("n")).cast("string").alias("image_id"))
    got = annotations.features(store, w, ["image_id"], SIZE)
    return got.select("conv_id", "turn", "image_id", F.md5("question").alias("question_md5"), F.round(_total("ft"), 6).alias("total"))


def jon02_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations of objects with the viewpoints that show them, from boxes with at least one visible position."""
    l = table(spark, sf, "lineitem").select(F.concat_ws("_", F.lit("s"), "l_suppkey").alias("scan_vp"), (F.col("l_partkey") % 50).alias("objid"), F.when(F.col("l_linenumber") > 1, F.array("l_linenumber")).otherwise(F.array().cast("array<int>")).alias("visible_pos"))  # noqa: E741
    seen = annotate.object_viewpoints(l.withColumn("visible_pos", F.col("visible_pos").cast("array<int>")))
    return seen.select("scan", "objid", F.size("end_vps").alias("n"), F.md5(F.array_join("end_vps", ",")).alias("vps_md5"))


def agg11_object_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean feature of the objects in sight of every viewpoint (its embedding times 1 to n)."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    seen = F.transform(F.sequence(F.lit(1), (F.col("vec_id") % 5 + 1).cast("int")), lambda k: F.transform("v", lambda x: x * k))
    m = e.select("vec_id", arrays.mean_vector(seen, 64).alias("m"))
    return m.select("vec_id", F.round(_total("m"), 5).alias("total"), F.size("m").alias("n"))


def _written(df: DataFrame, folder: str, kind: str) -> str:
    """A folder of text or JSON files of a frame."""
    df.write.mode("overwrite").format(kind).save(folder)
    return folder


def src01_records(spark: SparkSession, sf: str) -> DataFrame:
    """Instruction records written as JSON lines and read by their schema; absent fields are null, places are without gaps."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path_id"), F.col("source").alias("scan"), F.split("text", "\n").alias("instructions"))
    r = annotations.records(spark, _written(d, f"{shared_folder(spark)}/r2r.jsonl", "json"), "r2r")
    n = r.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("raw_idx").alias("places"), F.max("raw_idx").alias("last"))  # one row
    return r.crossJoin(F.broadcast(n)).select("path_id", "scan", F.size("instructions").alias("n_instructions"), F.col("heading").isNull().alias("no_heading"), ((F.col("n") == F.col("places")) & (F.col("last") == F.col("n") - 1)).alias("whole"))


def src06_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes read from one JSON object of objects by viewpoint, here nations by region."""
    n = table(spark, sf, "nation").select(F.concat(F.lit("r_"), F.col("n_regionkey").cast("string")).alias("vp"), F.col("n_nationkey").cast("string").alias("o"), F.struct(F.array(F.col("n_nationkey").cast("int")).alias("visible_pos")).alias("x"))
    by_vp = n.groupBy("vp").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("o", "x")))).alias("m"))
    one = by_vp.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("vp", "m")))).alias("value"))
    b = annotations.visible_boxes(spark, _written(one.coalesce(1), f"{shared_folder(spark)}/boxes", "text"))
    return b.select("scan_vp", "objid", F.col("visible_pos")[0].alias("visible"))


def src14_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Matrices read from texts of numbers between spaces, empty lines left out."""
    t = table(spark, sf, "region").select(F.concat_ws(" ", F.lit(" 1.5"), F.col("r_regionkey").cast("string"), F.lit("\n\n-2"), F.lit("0.25 ")).alias("value")).orderBy("r_regionkey")
    m = annotations.matrix(spark, _written(t.coalesce(1), f"{shared_folder(spark)}/matrix", "text"))
    each = m.select(F.posexplode("rows").alias("row", "r")).select("row", F.posexplode("r").alias("column", "x"))
    return each.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


def src16_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of scans read from lines, stripped, empty ones left out."""
    t = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 4 != 0, F.concat(F.lit("  scan"), F.col("c_custkey").cast("string"), F.lit(" "))).otherwise(F.lit(" ")).alias("value"))
    return annotations.lines(spark, _written(t, f"{shared_folder(spark)}/lines", "text"))


def src15_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a folder by name, without those of a certain ending."""
    folder = shared_folder(spark)
    for name in ("train", "val"):
        _written(table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("value"), F.concat(F.lit("k"), F.col("r_regionkey").cast("string")).alias("key")).repartition(1), f"{folder}/{name}", "json")
    found = annotations.listing(spark, folder, "*.json", "_SUCCESS")
    return found.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        obs11_samples, obs11_search_samples, obs11_dialog_samples, mth12_relative_views, txt09_scene_bundle, obs02_views_with_objects, st04_candidate_cache, trj15_missing_edges, flt02_object_truth, flt11_valid_options, flt12_nonfinite, agg17_parameter_groups, udf04_extracted,
        txt13_left, txt10_ratio, txt11_captions, str06_without_punctuation, st07_jumps, st08_expert_steps, st01_stream_graph, src09_catalog, snk08_aligned_features, snk05_answers, set02_merged,
        set06_paired, prj21_decoded, obs12_image_samples, jon02_objects, agg11_object_means, src01_records, src06_boxes, src14_matrix, src15_listing, src16_lines,
    )
}

_STEP = repr(geometry.STEP)
_FIRSTS = f"""{STEPS}, {VIEWS_OF},
firsts AS (SELECT instr_id, any_value(user_id) AS user_id, any_value(week) AS week, any_value(scan) AS scan, arg_min(node, pos) AS vp, count(*) AS n_path,
    12 + CAST(round((any_value(user_id) % 12) / 2.0 / {_STEP}) AS BIGINT) % 12 AS b FROM steps GROUP BY 1),
vecs AS (SELECT vec_id AS vp, list_sum(list_transform(embedding[1:{SIZE}], lambda x: CAST(x AS DOUBLE))) AS s FROM embeddings),
cand AS (SELECT f.instr_id, x.nbr, x.view, v.s * (x.view + 1) / 36 AS img,
    sin(a.h - (f.b % 12) * {_STEP}) + cos(a.h - (f.b % 12) * {_STEP}) + sin(a.el - (f.b // 12 - 1) * {_STEP}) + cos(a.el - (f.b // 12 - 1) * {_STEP}) AS ang
  FROM firsts f JOIN best x ON x.scan = f.scan AND x.vp = f.vp JOIN along a ON a.scan = x.scan AND a.vp = x.vp AND a.nbr = x.nbr JOIN vecs v ON v.vp = f.vp),
sweep AS (SELECT f.instr_id, k, v.s * (k + 1) / 36 AS img,
    sin((k % 12 - f.b % 12) * {_STEP}) + cos((k % 12 - f.b % 12) * {_STEP}) + sin((k // 12 - f.b // 12) * {_STEP}) + cos((k // 12 - f.b // 12) * {_STEP}) AS ang
  FROM firsts f JOIN vecs v USING (vp), (SELECT unnest(range(36)) AS k)),
csum AS (SELECT instr_id, count(*) AS n, sum(img) AS img, sum(ang) AS ang, string_agg(CAST(nbr AS VARCHAR), ',' ORDER BY nbr) AS ids FROM cand GROUP BY 1)"""
_RATIO = """SELECT '{0}' AS hypotheses, '{1}' AS option, CAST(sum({2}) AS BIGINT) AS testlen, round(sum({3}), 6) AS reflen, round((sum({2}) + 1e-15) / (sum({3}) + 1e-9), 6) AS ratio FROM {4}"""


def _ratio_sql() -> str:
    sizes = f"""WITH {text.GRAMS}, c AS (SELECT h.id, len(h.t) AS n, list(len(r.t) ORDER BY r.ref) AS l FROM h JOIN r USING (id) GROUP BY h.id, h.t)"""
    near = "CAST(list_min(list_transform(l, lambda x: abs(x - {0}) * 100000 + x)) % 100000 AS DOUBLE)"
    rows = [
        _RATIO.format(k, o, n, v, "c")
        for k, n in (("own", "n"), ("other", "l[1]"))
        for o, v in (("closest", near.format(n)), ("shortest", "CAST(list_min(l) AS DOUBLE)"), ("average", "list_avg(l)"))
    ]
    return sizes + " " + " UNION ALL ".join(rows)


_PUNCTUATION = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in arrays.PUNCTUATION) + "]"

ORACLE = {
    "agg11_object_means": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) * (vec_id % 5 + 2) / 2, 5) AS total, len(embedding) AS n FROM embeddings",
    "src01_records": "SELECT doc_id AS path_id, source AS scan, len(string_split(text, chr(10))) AS n_instructions, true AS no_heading, true AS whole FROM documents",
    "src06_boxes": "SELECT 'r_' || n_regionkey AS scan_vp, CAST(n_nationkey AS VARCHAR) AS objid, CAST(n_nationkey AS INTEGER) AS visible FROM nation",
    "src14_matrix": """SELECT 0 AS "column", 2 * count(*) AS n, CAST(count(*) * -0.5 AS DOUBLE) AS total FROM region UNION ALL SELECT 1, 2 * count(*), CAST(sum(r_regionkey) + count(*) * 0.25 AS DOUBLE) FROM region""",
    "src15_listing": "SELECT 'train' AS folder, 1 AS n UNION ALL SELECT 'val', 1",
    "src16_lines": "SELECT 'scan' || c_custkey AS value FROM customer WHERE c_custkey % 4 <> 0",
    "obs11_samples": f"""WITH {_FIRSTS}, wide AS (SELECT instr_id, sum(img + ang) AS t FROM sweep GROUP BY 1)
SELECT row_number() OVER (ORDER BY f.user_id, f.week) - 1 AS sample_idx, f.instr_id, CAST(f.b AS INTEGER) AS view_index, coalesce(c.n, 0) AS n_candidates, 36 AS n_views, round(w.t, 5) AS feature_sum,
       round(coalesce(c.img + c.ang, 0.0), 5) AS candidate_sum, round(n.x + 2 * n.y + 3 * n.z, 6) AS place, n_path
FROM firsts f JOIN wide w USING (instr_id) JOIN nodes n ON n.scan = f.scan AND n.vp = f.vp LEFT JOIN csum c ON c.instr_id = f.instr_id""",
    "obs02_views_with_objects": f"""WITH {_FIRSTS},
free AS (SELECT s.instr_id, count(*) AS n, sum(img) AS img, sum(ang) AS ang FROM sweep s WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.instr_id = s.instr_id AND c.view = s.k) GROUP BY 1),
objs AS (SELECT f.instr_id, f.b, f.vp, k FROM firsts f, (SELECT unnest([1, 2, 3]) AS k) WHERE f.vp % 3 = 0 AND k <= f.vp % 5 + 1),
osum AS (SELECT instr_id, count(*) AS n, string_agg(CAST(vp * 10 + k AS VARCHAR), ',' ORDER BY k) AS ids,
    sum(sin(vp % 7 + k - (b % 12) * {_STEP}) + cos(vp % 7 + k - (b % 12) * {_STEP}) + sin(k / 4.0 - (b // 12 - 1) * {_STEP}) + cos(k / 4.0 - (b // 12 - 1) * {_STEP})
      + k * 20.0 / 224 + k * 10.0 / 224 + k * 20.0 / 224 * (k * 10.0 / 224)) AS t FROM objs GROUP BY 1)
SELECT f.instr_id, CAST(coalesce(c.n, 0) + coalesce(r.n, 0) AS INTEGER) AS view_lens, CAST(coalesce(o.n, 0) AS INTEGER) AS obj_lens, repeat('1', CAST(coalesce(c.n, 0) AS INTEGER)) || repeat('0', CAST(coalesce(r.n, 0) AS INTEGER)) AS nav_types,
       coalesce(c.ids, '') AS cand_vpids, round(coalesce(c.img, 0) + coalesce(r.img, 0), 5) AS img_sum, round(coalesce(c.ang, 0) + coalesce(r.ang, 0) + 3 * (coalesce(c.n, 0) + coalesce(r.n, 0)), 5) AS loc_sum,
       coalesce(o.ids, '') AS obj_ids, round(coalesce(o.t, 0.0), 6) AS obj_loc_sum
FROM firsts f LEFT JOIN csum c ON c.instr_id = f.instr_id LEFT JOIN free r ON r.instr_id = f.instr_id LEFT JOIN osum o ON o.instr_id = f.instr_id""",
    "st04_candidate_cache": f"""WITH {STEPS}, {VIEWS_OF},
w AS (SELECT b.scan, b.vp, b.nbr, (b.view + s.pos) % 36 AS view, row_number() OVER (PARTITION BY b.scan, b.vp, b.nbr ORDER BY s.week DESC, s.pos DESC, s.user_id DESC) AS k FROM steps s JOIN best b ON b.scan = s.scan AND b.vp = s.node)
SELECT scan, vp, nbr, view FROM w WHERE k = 1""",
    "trj15_missing_edges": f"""WITH {STEPS}, m AS (SELECT instr_id, scan, pos, lag(node) OVER (PARTITION BY instr_id ORDER BY pos) AS prev, node FROM steps)
SELECT instr_id, pos, prev, node FROM m WHERE prev <> node AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.scan = m.scan AND e.src = m.prev AND e.dst = m.node)""",
    "flt02_object_truth": f"WITH {STEPS} SELECT instr_id, any_value(scan) AS scan, count(*) AS n, any_value(user_id) AS objid FROM steps WHERE user_id % 3 <> 0 GROUP BY 1",
    "flt11_valid_options": """WITH v AS (SELECT vec_id, embedding AS e, CASE WHEN vec_id % 4 = 0 THEN 0 ELSE least(vec_id % 9, len(embedding)) END AS n FROM embeddings)
SELECT vec_id, CAST(n AS INTEGER) AS n_valid, CAST(greatest(n, 1) AS INTEGER) AS divisor, round(CASE WHEN n = 0 AND vec_id % 5 <> 0 THEN 0.0 ELSE CAST(e[1] AS DOUBLE) END, 6) AS stop, n = 0 AND vec_id % 5 <> 0 AS forced FROM v""",
    "flt12_nonfinite": "SELECT vec_id AS position, 'layer.' || vec_id AS name FROM embeddings WHERE vec_id % 7 = 3 OR vec_id % 11 = 5 ORDER BY 1 LIMIT 20",
    "agg17_parameter_groups": """WITH p AS (SELECT p_partkey % 6 AS k, p_size FROM part)
SELECT CASE WHEN k IN (0, 4) THEN 'lang_model.adapter' WHEN k = 1 THEN 'lang_model.non_adapter' WHEN k = 2 THEN 'vision' WHEN k = 3 THEN 'projector' ELSE 'embed' END AS "group", count(*) AS n_tensors, CAST(sum(p_size) AS BIGINT) AS n_numbers FROM p GROUP BY 1""",
    "udf04_extracted": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm, round(CAST(list_max(embedding) AS DOUBLE), 6) AS most FROM embeddings",
    "txt13_left": f"""WITH d AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch, list_transform({words_sql("coalesce(text, '')")}, lambda w: length(w)) AS ids FROM documents),
c AS (SELECT doc_id, batch, CASE WHEN len(ids) > 1024 THEN ids[-1024:] ELSE ids END AS ids FROM d),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS most FROM c)
SELECT doc_id, batch, CAST(most AS INTEGER) AS most, len(ids) AS n, md5(array_to_string(list_concat(list_transform(range(most - len(ids)), lambda k: 0), ids), ',')) AS ids_md5,
       md5(array_to_string(list_concat(list_transform(range(most - len(ids)), lambda k: 0), list_transform(ids, lambda k: 1)), ',')) AS mask_md5 FROM m""",
    "txt10_ratio": _ratio_sql(),
    "txt11_captions": f"WITH b AS ({text.TOTAL}) SELECT 'bleu1' AS metric, bleu1 AS value FROM b UNION ALL SELECT 'bleu2', bleu2 FROM b UNION ALL SELECT 'bleu3', bleu3 FROM b UNION ALL SELECT 'bleu4', bleu4 FROM b",
    "str06_without_punctuation": f"""WITH t AS (SELECT conv_id, turn, regexp_replace(lower(text), '([.,!?;:])', ' \\1 ', 'g') AS s FROM conversations)
SELECT conv_id, turn, md5(array_to_string(list_filter({words_sql("s")}, lambda x: NOT list_contains({_PUNCTUATION}, x)), ' ')) AS md5 FROM t""",
    "st07_jumps": f"WITH {WALKED} SELECT instr_id, goal AS cur, true AS arrived, round(gt_lengths, 6) AS moved FROM walked",
    "st08_expert_steps": f"""WITH {STEPS}, n AS (SELECT instr_id, pos, node, lead(node) OVER (PARTITION BY instr_id ORDER BY pos) AS nxt FROM steps)
SELECT instr_id, pos, CASE WHEN nxt IS NULL THEN 0 ELSE (SELECT count(DISTINCT s.node) FROM steps s WHERE s.instr_id = n.instr_id AND s.node < n.nxt) + 1 END AS action FROM n""",
    "st01_stream_graph": f"""WITH {STEPS}, k AS (SELECT instr_id, node AS vp FROM steps UNION SELECT s.instr_id, e.dst FROM steps s JOIN edges e ON e.scan = s.scan AND e.src = s.node)
SELECT k.instr_id, count(*) AS n_known, count(DISTINCT s.node) AS n_visited FROM k LEFT JOIN (SELECT DISTINCT instr_id, node FROM steps) s ON s.instr_id = k.instr_id AND s.node = k.vp GROUP BY 1""",
    "src09_catalog": """WITH t AS (SELECT sum(CAST(embedding[1] AS DOUBLE)) AS s, count(*) AS n FROM embeddings)
SELECT 'r2r' AS task, 'features' AS kind, 'mp3d' AS store, round(s, 4) AS total, n FROM t UNION ALL SELECT 'reverie', 'features', 'mp3d', round(s, 4), n FROM t
UNION ALL SELECT 'reverie', 'objects', 'reverie', round(s, 4), n FROM t UNION ALL SELECT 'llava', 'features', 'coco', round(2 * s, 4), n FROM t""",
    "snk08_aligned_features": "SELECT vec_id, label, true AS aligned, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings",
    "snk05_answers": f"WITH {text.PAIRS} SELECT id AS instr_id, md5(hyp) AS answer_md5, CASE WHEN list_contains(refs, hyp) THEN 1.0 ELSE 0.0 END AS em FROM pairs",
    "set02_merged": "SELECT lang, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang FROM documents WHERE doc_id % 3 = 0) GROUP BY 1",
    "set06_paired": f"WITH {text.PAIRS} SELECT id, md5(hyp) AS hyp_md5, len(refs) AS n_refs FROM pairs",
    "prj21_decoded": "SELECT doc_id, md5(chr(65533) || coalesce(text, '') || chr(65533)) AS md5 FROM documents",
    "obs12_image_samples": f"""WITH e AS (SELECT vec_id, round(list_sum(list_transform(embedding[1:{SIZE}], lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings)
SELECT conv_id, turn, CAST(vec_id AS VARCHAR) AS image_id, md5(text) AS question_md5, total FROM conversations JOIN e ON vec_id = conv_id % (SELECT max(vec_id) + 1 FROM embeddings) WHERE role = 'user'""",
    "jon02_objects": """SELECT 's' AS scan, l_partkey % 50 AS objid, count(*) AS n, md5(string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR))) AS vps_md5 FROM lineitem WHERE l_linenumber > 1 GROUP BY 2""",
}

_DRAW = lambda seed: f"(CAST(('0x' || substr(md5('{seed}|' || instr_id), 1, {sampling.DIGITS})) AS BIGINT) / {float(16**sampling.DIGITS)!r})"
ORACLE["obs11_search_samples"] = f"""WITH RECURSIVE {navigation._PATHS.replace(DIST, STEPS, 1)},
f AS (SELECT instr_id, user_id, week, scan, first(node ORDER BY pos) AS vp FROM steps GROUP BY ALL),
c AS (SELECT *, CAST(floor({_DRAW(23)} * 3) AS BIGINT) AS pick, {_DRAW(24)} * {geometry.FULL!r} AS heading, row_number() OVER (ORDER BY user_id, week) - 1 AS sample_idx FROM f)
SELECT c.sample_idx, c.instr_id, CAST(12 + CAST(round(heading / {geometry.STEP!r}) AS BIGINT) % 12 AS INTEGER) AS view_index, p.vp AS goal, CAST(w.hops + 1 AS BIGINT) AS n_path, md5(w.path) AS path_md5, 36 AS n_views, 'soon' AS data_type
FROM c JOIN picks p ON p.scan = c.scan AND p.k = c.pick JOIN ways w ON w.scan = c.scan AND w.src = c.vp AND w.dst = p.vp AND w.cur = w.src"""
ORACLE["obs11_dialog_samples"] = f"""WITH {PICKS},
t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Question: ' ELSE 'Answer: ' END || text || CASE WHEN right(text, 1) IN ('?', '.') THEN '' ELSE '.' END || chr(10) AS line
  FROM conversations WHERE role IN ('user', 'assistant') AND length(text) > 0),
dd AS (SELECT conv_id, 'The goal room contains a item' || conv_id || '.' || chr(10) || string_agg(line, '' ORDER BY turn) AS t FROM t GROUP BY 1),
s AS (SELECT conv_id, left(t, length(t) - 1) AS t FROM dd), w AS (SELECT *, {words_sql("t")} AS w, row_number() OVER (ORDER BY conv_id) - 1 AS sample_idx FROM s),
z AS (SELECT scan, vp, row_number() OVER (ORDER BY scan) - 1 AS place, count(*) OVER () AS scans FROM picks WHERE k = 0)
SELECT sample_idx, 'cvdn_' || conv_id AS instr_id, z.vp, CAST(12 + CAST(round((conv_id % 12) / 2.0 / {geometry.STEP!r}) AS BIGINT) % 12 AS INTEGER) AS view_index,
       md5(CASE WHEN len(w) > 128 THEN array_to_string(w[1:128], ' ') ELSE t END) AS instruction_md5, 1 AS n_path, 'cvdn' AS data_type FROM w JOIN z ON z.place = conv_id % scans"""
_REL = f"sin((view % 12 - base % 12) * {geometry.STEP!r}), cos((view % 12 - base % 12) * {geometry.STEP!r}), sin((view // 12 - base // 12) * {geometry.STEP!r}), cos((view // 12 - base // 12) * {geometry.STEP!r})"
ORACLE["mth12_relative_views"] = f"""WITH {NODES}, r AS (SELECT scan, vp, view, [{_REL}] AS f FROM (SELECT scan, vp, vp % 36 AS base FROM nodes), (SELECT unnest(range(36)) AS view))
SELECT scan, vp, {", ".join(f"round(sum(f[{k + 1}] * (view + 1)), 5) AS f{k}" for k in range(4))}, count(*) AS n FROM r GROUP BY 1, 2"""
