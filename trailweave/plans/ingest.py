"""Annotation, filter, set, order and sink queries over records derived from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.functions import arrays
from trailweave.operators import annotate as A
from trailweave.plans.base_sql import EDGES, NODES, STEPS, stripped_sql, words_sql
from trailweave.sources import annotations, sinks, views
from trailweave.sources.tables import table


def _text(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as records: lines are instructions, word lengths their encodings, ids in quotes the fine-grained texts."""
    d = table(spark, sf, "documents")
    lines = F.split("text", "\n")
    lengths = F.transform(lines, lambda s: F.transform(arrays.words(s), lambda w: F.length(w)))
    fine = F.concat(F.lit("[[['go','"), F.col("doc_id").cast("string"), F.lit("'],['stop']],[['wait']]]"))
    chunks = F.array(F.array(F.array(F.lit(0), F.lit(2)), F.array(F.lit(2), F.lit(3))), F.array(F.array(F.lit(0), (F.col("doc_id") % 4).cast("int"))))
    return d.select(
        F.col("doc_id").alias("raw_idx"), F.col("doc_id").alias("path_id"), F.col("source").alias("scan"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") / 10.0).alias("heading"),
        lines.alias("instructions"), lengths.alias("instr_encodings"), fine.alias("new_instructions"), chunks.alias("chunk_view"),
    )


def prj01_instructions(spark: SparkSession, sf: str) -> DataFrame:
    """A row per instruction with ids, running numbers, cut encodings and default headings."""
    r = A.instruction_rows(_records(spark, sf).drop("new_instructions", "chunk_view"), 100)
    return r.select("instr_id", "raw_idx", "sample_idx", "heading", "scan", F.length("instruction").alias("n_chars"), F.size("instr_encoding").alias("n_enc"), F.md5(_text("instr_encoding")).alias("enc_md5"))


def prj05_fine_grained(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-instructions and their views, where a record has some for the instruction."""
    r = A.fine_grained(A.by_instruction(_records(spark, sf)))
    return r.select("path_id", "j", F.array_join("fg_instruction", "|").alias("fg_instruction"), _text("fg_view").alias("fg_view"))


def prj02_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Running numbers over all order lines, without a global sort in one task."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")  # noqa: E741
    return A.numbered(l, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], width=1000).select("l_orderkey", "l_linenumber", "sample_idx")


def prj10_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as a map by their part's last digit: of equal keys the last line stays."""
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l"))
    o = o.select("l_orderkey", F.transform("l", lambda x: F.struct((x["l_partkey"] % 10).alias("k"), x["l_partkey"].alias("part"))).alias("l"))
    m = A.last_of_key("l", "k")
    pairs = F.array_sort(F.map_entries(m))
    return o.select("l_orderkey", F.size(m).alias("n"), F.array_join(F.transform(pairs, lambda e: F.concat_ws(":", e["key"], e["value"]["part"])), ",").alias("map"))


def prj11_dialogs(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as navigation dialogs, whole and cut to 128 words."""
    d = views.dialogs(spark, sf)
    rows = A.dialog_rows(d.select(F.col("conv_id").alias("raw_idx"), F.col("conv_id").alias("inst_idx"), "target", F.lit("start").alias("start_pano"), F.lit(None).cast("array<string>").alias("planner_path"), "dialog_history"))
    whole = d.select(F.col("conv_id").alias("inst_idx"), A.dialog_text(F.col("target"), "dialog_history").alias("t"))
    return rows.join(whole, "inst_idx").select("instr_id", "sample_idx", F.md5("t").alias("text_md5"), F.md5("instruction").alias("cut_md5"), F.size("path").alias("path_size"))


def prj14_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions by scene and back: benchmark passages as questions of documents' sources."""
    q, lost = _scenes(spark, sf)
    r = A.question_rows(q)
    return r.select("scene_id", "question_id", F.md5("question").alias("question_md5"), F.array_join("answers", "|").alias("answers"), F.size("image_info").alias("n_images"))


def _scenes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Forty documents in a row ask about one scene; every fifth scene has no images."""
    d = table(spark, sf, "documents").withColumn("k", F.floor(F.col("doc_id") / 40))
    scene = F.concat(F.lit("scene"), F.col("k").cast("string")).alias("scene_id")
    q = d.select(scene, F.col("doc_id").cast("string").alias("question_id"), F.col("text").alias("question"), F.array(F.upper("lang"), F.upper("source")).alias("answers"))
    i = d.select("k").distinct().where("k % 5 <> 0").select(scene, F.explode(F.sequence(F.lit(8), F.lit(12))).alias("n"))
    return A.scenes(q, i.select("scene_id", F.col("n").cast("string").alias("image_id"), F.array(F.array(F.lit(1.0))).alias("pose")))


def flt05_missing_scenes(spark: SparkSession, sf: str) -> DataFrame:
    """How many questions no scene has."""
    return _scenes(spark, sf)[1]


def agg05_scenes(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes with their questions, images in numeric order."""
    q, _ = _scenes(spark, sf)
    return q.select("scene_id", F.size("annotation").alias("n_questions"), F.array_join("image_info.image_id", ",").alias("images"))


def prj15_turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """First user turn and the reply to it, as image conversations."""
    t = table(spark, sf, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    t = t.withColumn("role0", F.lag("role").over(order)).withColumn("text0", F.lag("text").over(order)).where("role = 'assistant' AND role0 = 'user'")
    first = t.groupBy("conv_id").agg(F.min_by(F.struct("text0", "text"), "turn").alias("p"))
    conv = F.array(F.struct(F.lit("human").alias("from"), F.concat(F.lit(" <image>\n"), F.col("p.text0")).alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("p.text").alias("value")))
    r = A.turn_pair_rows(first.select(F.col("conv_id").alias("id"), F.concat(F.col("conv_id").cast("string"), F.lit(".jpg.png")).alias("image"), conv.alias("conversations")))
    return r.select("id", "image_id", F.md5("question").alias("question_md5"), F.md5(F.col("answers")[0]).alias("answer_md5"))


def prj16_captions(spark: SparkSession, sf: str) -> DataFrame:
    """Captions to learn from and to compare with, from nations of regions."""
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").cast("long").alias("sentid"), F.lower("n_name").alias("raw")))).alias("sentences"))
    r = n.select(F.col("n_regionkey").cast("long").alias("imgid"), F.concat(F.lit("COCO_x_"), F.col("n_regionkey").cast("string"), F.lit(".jpg")).alias("filename"), "sentences")
    a = A.caption_rows(r, True).select(F.col("sentid").alias("id"), "image", F.col("label").alias("text"))
    b = A.caption_rows(r, False).select((F.col("imgid") + 1000).alias("id"), "image", F.array_join("refs", "|").alias("text"))
    return a.unionByName(b)


def prj17_unit_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Box angles as shares of a turn."""
    p = lambda h, e: F.struct(h.alias("heading"), e.alias("elevation"))
    x, y = F.col("value") / 20, (F.col("user_id") % 7) / 3.0
    b = F.array(F.struct(F.col("event_id").alias("vp"), p(x, y).alias("center"), F.array(*(p(x + a, y + b) for a, b in ((-0.1, 0.1), (0.1, 0.1), (0.1, -0.1), (-0.1, -0.1)))).alias("corners")))
    e = table(spark, sf, "events").select("event_id", b.alias("b"))
    u = e.select("event_id", A.unit_boxes("b").alias("u"))
    return u.select("event_id", F.round(F.col("u")[0]["heading"], 6).alias("heading"), F.round(F.col("u")[0]["elevation"], 6).alias("elevation"), F.round(F.col("u")[0]["corners"][2]["elevation"], 6).alias("low"))


def prj20_object_records(spark: SparkSession, sf: str) -> DataFrame:
    """Parallel arrays of an order's lines as records; the shorter array ends in nulls."""
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("l"))
    r = o.select("l_orderkey", F.col("l.l_partkey").alias("obj_ids"), F.slice("l.l_suppkey", 1, 2).alias("names"))
    return A.object_records(r, ["obj_ids", "names"]).select("l_orderkey", F.col("row").cast("long").alias("row"), "obj_ids", "names")


def prj19_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features looked up by key, their first eight numbers joined with four of an angle and cut apart again."""
    store = table(spark, sf, "embeddings").select(views.scan().alias("scan"), F.col("vec_id").alias("vp"), F.transform("embedding", lambda x: x.cast("double")).alias("ft"))
    got = annotations.features(store, views.nodes(spark, sf).select("scan", "vp"), ["scan", "vp"], 8)
    both = F.concat("ft", F.array(*(F.lit(float(k)) for k in range(4))))
    r = got.select("scan", "vp", both.alias("f"))
    return r.select("scan", "vp", F.size("f").alias("size"), F.round(F.aggregate(F.slice("f", 1, 8), F.lit(0.0), lambda a, x: a + x), 6).alias("image_sum"), F.aggregate(F.slice("f", 9, 4), F.lit(0.0), lambda a, x: a + x).alias("angle_sum"))


def grf06_resampled(spark: SparkSession, sf: str) -> DataFrame:
    """Every annotation keeps one of its end viewpoints, the same on every run."""
    p = views.picks(spark, sf).groupBy("scan").agg(F.array_sort(F.collect_list("vp")).alias("end_vps"))
    r = A.resampled_end(p.withColumn("instr_id", F.col("scan").cast("string")), 7)
    return r.select("scan", F.array_contains("end_vps", F.col("end_vp")).alias("is_one"))


# ---- sets, order and limits ----------------------------------------------------------------------


def set01_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations of two sources together, absent columns null, nothing removed."""
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("documents").alias("data_type"), "lang")
    b = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("pages").alias("data_type"), "url")
    return a.unionByName(b, allowMissingColumns=True).groupBy("data_type").agg(F.count(F.lit(1)).alias("n"), F.count("lang").alias("n_lang"), F.count("url").alias("n_url"))


def set03_undirected(spark: SparkSession, sf: str) -> DataFrame:
    """Steps of all trajectories as undirected edges, each once in both directions."""
    s = views.steps(spark, sf)
    e = s.select("scan", F.lag("node").over(Window.partitionBy("instr_id").orderBy("pos")).alias("a"), F.col("node").alias("b")).where("a IS NOT NULL AND a <> b")
    return e.union(e.select("scan", F.col("b").alias("a"), F.col("a").alias("b"))).distinct().groupBy("scan").agg(F.count(F.lit(1)).alias("n_edges"))


def win01_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Steps with the one before, how many viewpoints were visited so far, and whether this one is new."""
    s = views.steps(spark, sf)
    w = Window.partitionBy("instr_id").orderBy("pos")
    so_far = F.collect_set("node").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return s.select("instr_id", "pos", "node", F.lag("node").over(w).alias("prev"), F.size(so_far).alias("n_visited"), (F.row_number().over(Window.partitionBy("instr_id", "node").orderBy("pos")) == 1).alias("first_visit"))


def win04_first_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Of predictions with one id (a user's weeks) the first to arrive counts."""
    p = views.predictions(spark, sf)
    return p.groupBy("user_id").agg(F.min_by(F.size("trajectory"), "week").alias("n_steps"), F.min("week").alias("week"))


def win05_last_visit(spark: SparkSession, sf: str) -> DataFrame:
    """The last visit of every viewpoint: who and when, the last written wins."""
    s = views.steps(spark, sf)
    return s.groupBy("scan", "node").agg(F.max_by("instr_id", F.struct("week", "pos", "instr_id")).alias("instr_id"), F.count(F.lit(1)).alias("n_visits"))


def sort02_retention(spark: SparkSession, sf: str) -> DataFrame:
    """Of all checkpoints (parts by price) the one beyond the ten best is the next to go."""
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return p.orderBy(F.desc("p_retailprice"), "p_partkey").offset(10).limit(1).select("p_partkey")


def lim01_head(spark: SparkSession, sf: str) -> DataFrame:
    """The first twenty annotations in raw order (a debugging limit, as the feature is)."""
    return table(spark, sf, "documents").select("doc_id", "lang").orderBy("doc_id").limit(20)


def lim03_objects(spark: SparkSession, sf: str) -> DataFrame:
    """At most three parts of each supplier, the smallest numbers first."""
    l = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()  # noqa: E741
    return l.withColumn("k", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_partkey"))).where("k <= 3").select("l_suppkey", "l_partkey", "k")


# ---- sinks ---------------------------------------------------------------------------------------


def _steps_text(c: F.Column) -> F.Column:
    return F.array_join(F.transform(c, lambda s: F.concat_ws("/", s)), " ")


def snk01_navigation(spark: SparkSession, sf: str) -> DataFrame:
    """Navigation results in file shape."""
    f = sinks.navigation_file(views.predictions(spark, sf).select("instr_id", "trajectory"))
    return f.select("instr_id", F.md5(_steps_text(F.col("trajectory"))).alias("trajectory_md5"))


def snk02_grounding(spark: SparkSession, sf: str) -> DataFrame:
    """Grounding results: no object counts as 0."""
    p = views.predictions(spark, sf).select("instr_id", "trajectory", F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string")).alias("pred_objid"))
    return sinks.grounding_file(p).select("instr_id", "predObjId")


def snk03_search(spark: SparkSession, sf: str) -> DataFrame:
    """Search results: numbers from ids, directions nested."""
    p = views.predictions(spark, sf).select(F.concat_ws("_", F.lit("soon"), "user_id", F.concat_ws("-", "week", F.lit("x"))).alias("instr_id"), "trajectory", F.when(F.col("user_id") % 2 == 0, F.array(F.lit(0.5), F.lit(0.25))).alias("pred_obj_direction"))
    f = sinks.search_file(p)
    return f.select("instr_id", F.col("trajectory")[0]["obj_heading"][0].alias("obj_heading"), F.col("trajectory")[0]["obj_elevation"][0].alias("obj_elevation"), F.size(F.col("trajectory")[0]["path"]).alias("n"))


def snk04_dialog(spark: SparkSession, sf: str) -> DataFrame:
    """Dialog results: the id's last field twice."""
    f = sinks.dialog_file(views.predictions(spark, sf).select("instr_id", "trajectory"))
    return f.select("instr_id", "instr_idx", "inst_idx", F.size("trajectory").alias("n"))


def snk06_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Question results under the leaderboard's names."""
    q = table(spark, sf, "benchmark").select("item_id", F.array("text").alias("generated_sentences"))
    return sinks.question_file(q).select("item_id", F.col("answer_top10")[0].alias("answer"), F.size("pred_bbox").alias("n_boxes"))


def snk09_graph_json(spark: SparkSession, sf: str) -> DataFrame:
    """A scan's graph as one JSON text, read back: nodes and edges of it."""
    n, e = views.nodes(spark, sf).select("scan", "vp"), views.edges(spark, sf).select("scan", "src", "dst")
    g = sinks.graph_json(n, e, ["scan"])
    back = F.from_json("json", "nodes array<struct<vp:long>>, edges array<struct<src:long,dst:long>>")
    return g.select("scan", back.alias("b")).select("scan", F.size("b.nodes").alias("n_nodes"), F.size("b.edges").alias("n_edges"), F.aggregate("b.edges", F.lit(0).cast("long"), lambda a, x: a + x["src"] * 3 + x["dst"]).alias("checksum"))


QUERIES = {
    f.__name__: f
    for f in (
        prj01_instructions, prj05_fine_grained, prj02_numbers, prj10_last_wins, prj11_dialogs, prj14_questions, flt05_missing_scenes, agg05_scenes, prj15_turn_pairs, prj16_captions,
        prj17_unit_boxes, prj20_object_records, prj19_features, grf06_resampled, set01_sources, set03_undirected, win01_moves, win04_first_predictions, win05_last_visit, sort02_retention,
        lim01_head, lim03_objects, snk01_navigation, snk02_grounding, snk03_search, snk04_dialog, snk06_questions, snk09_graph_json,
    )
}

_LINES = """lines AS (SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS j, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"""
_SCENE = """q AS (SELECT 'scene' || doc_id // 40 AS scene_id, CAST(doc_id AS VARCHAR) AS question_id, text AS question, lower(upper(lang)) || '|' || lower(upper(source)) AS answers FROM documents),
i AS (SELECT DISTINCT 'scene' || doc_id // 40 AS scene_id, 5 AS n_images FROM documents WHERE (doc_id // 40) % 5 <> 0)"""

ORACLE = {
    "prj01_instructions": f"""WITH {_LINES}, e AS (SELECT *, list_transform({words_sql("line")}, lambda w: length(w)) AS enc FROM lines)
SELECT 'r2r_' || doc_id || '_' || j AS instr_id, doc_id AS raw_idx, row_number() OVER (ORDER BY doc_id, j) - 1 AS sample_idx, CASE WHEN doc_id % 3 = 0 THEN doc_id / 10.0 ELSE 0.0 END AS heading,
       source AS scan, length(line) AS n_chars, len(enc[1:100]) AS n_enc, md5(array_to_string(enc[1:100], ',')) AS enc_md5 FROM e""",
    "prj05_fine_grained": f"""WITH {_LINES}
SELECT doc_id AS path_id, j, CASE j WHEN 0 THEN 'go ' || doc_id || '|stop' WHEN 1 THEN 'wait' END AS fg_instruction,
       CASE j WHEN 0 THEN '0,0,1' WHEN 1 THEN rtrim(repeat('0,', CAST(doc_id % 4 AS INTEGER)), ',') END AS fg_view FROM lines""",
    "prj02_numbers": "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS sample_idx FROM lineitem",
    "prj10_last_wins": """WITH k AS (SELECT l_orderkey, l_partkey % 10 AS k, arg_max(l_partkey, l_linenumber * 1000000000000 + l_partkey * 10000 + l_suppkey) AS part FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, count(*) AS n, string_agg(k || ':' || part, ',' ORDER BY k) AS map FROM k GROUP BY 1""",
    "prj11_dialogs": f"""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Question: ' ELSE 'Answer: ' END || text || CASE WHEN right(text, 1) IN ('?', '.') THEN '' ELSE '.' END || chr(10) AS line
  FROM conversations WHERE role IN ('user', 'assistant') AND length(text) > 0),
d AS (SELECT conv_id, 'The goal room contains a item' || conv_id || '.' || chr(10) || string_agg(line, '' ORDER BY turn) AS t FROM t GROUP BY 1),
s AS (SELECT conv_id, left(t, length(t) - 1) AS t FROM d), w AS (SELECT *, {words_sql("t")} AS w, row_number() OVER (ORDER BY conv_id) - 1 AS sample_idx FROM s)
SELECT 'cvdn_' || sample_idx || '_' || conv_id AS instr_id, sample_idx, md5(t) AS text_md5, md5(CASE WHEN len(w) > 128 THEN array_to_string(w[1:128], ' ') ELSE t END) AS cut_md5, 1 AS path_size FROM w""",
    "prj14_questions": f"WITH {_SCENE} SELECT scene_id, question_id, md5(question) AS question_md5, answers, n_images FROM q JOIN i USING (scene_id)",
    "flt05_missing_scenes": f"WITH {_SCENE} SELECT count(*) AS not_exist FROM q WHERE scene_id NOT IN (SELECT scene_id FROM i)",
    "agg05_scenes": f"WITH {_SCENE} SELECT scene_id, count(*) AS n_questions, '8,9,10,11,12' AS images FROM q JOIN i USING (scene_id) GROUP BY 1",
    "prj15_turn_pairs": f"""WITH t AS (SELECT *, lag(role) OVER w AS role0, lag(text) OVER w AS text0 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM t WHERE role = 'assistant' AND role0 = 'user') WHERE k = 1)
SELECT conv_id AS id, CAST(conv_id AS VARCHAR) AS image_id, md5({stripped_sql("text0")}) AS question_md5, md5(text) AS answer_md5 FROM f""",
    "prj16_captions": """SELECT CAST(n_nationkey AS BIGINT) AS id, n_regionkey || '.jpg' AS image, lower(n_name) || '</s>' AS text FROM nation
UNION ALL SELECT n_regionkey + 1000, n_regionkey || '.jpg', string_agg(lower(n_name), '|' ORDER BY n_nationkey) FROM nation GROUP BY n_regionkey""",
    "prj17_unit_boxes": """SELECT event_id, round(value / 20 / (2 * pi()), 6) AS heading, round(((user_id % 7) / 3.0 + pi()) / (2 * pi()), 6) AS elevation, round(((user_id % 7) / 3.0 - 0.1 + pi()) / (2 * pi()), 6) AS low FROM events""",
    "prj20_object_records": """WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS row FROM lineitem)
SELECT l_orderkey, row, l_partkey AS obj_ids, CASE WHEN row < 2 THEN l_suppkey END AS names FROM o""",
    "prj19_features": f"""WITH {NODES} SELECT scan, vp, 12 AS size, round(list_sum(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE))), 6) AS image_sum, 6.0 AS angle_sum FROM nodes JOIN embeddings ON vec_id = vp""",
    "grf06_resampled": f"WITH {NODES} SELECT scan, true AS is_one FROM nodes GROUP BY 1",
    "set01_sources": "SELECT 'documents' AS data_type, count(*) AS n, count(lang) AS n_lang, 0 AS n_url FROM documents UNION ALL SELECT 'pages', count(*), 0, count(url) FROM pages",
    "set03_undirected": f"""WITH {STEPS}, e AS (SELECT scan, lag(node) OVER (PARTITION BY instr_id ORDER BY pos) AS a, node AS b FROM steps),
u AS (SELECT scan, a, b FROM e WHERE a IS NOT NULL AND a <> b UNION SELECT scan, b, a FROM e WHERE a IS NOT NULL AND a <> b) SELECT scan, count(*) AS n_edges FROM u GROUP BY 1""",
    "win01_moves": f"""WITH {STEPS}, f AS (SELECT *, lag(node) OVER (PARTITION BY instr_id ORDER BY pos) AS prev, row_number() OVER (PARTITION BY instr_id, node ORDER BY pos) = 1 AS first_visit FROM steps)
SELECT instr_id, pos, node, prev, sum(CASE WHEN first_visit THEN 1 ELSE 0 END) OVER (PARTITION BY instr_id ORDER BY pos) AS n_visited, first_visit FROM f""",
    "win04_first_predictions": f"WITH {STEPS}, p AS (SELECT user_id, week, count(*) AS n FROM steps GROUP BY 1, 2) SELECT user_id, arg_min(n, week) AS n_steps, min(week) AS week FROM p GROUP BY 1",
    "win05_last_visit": f"""WITH {STEPS} SELECT scan, node, instr_id, n_visits FROM (SELECT *, count(*) OVER (PARTITION BY scan, node) AS n_visits, row_number() OVER (PARTITION BY scan, node ORDER BY week DESC, pos DESC, instr_id DESC) AS k FROM steps) WHERE k = 1""",
    "sort02_retention": "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1 OFFSET 10",
    "lim01_head": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20",
    "lim03_objects": "SELECT l_suppkey, l_partkey, k FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS k FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) WHERE k <= 3",
    "snk01_navigation": f"WITH {STEPS} SELECT user_id || '_' || week AS instr_id, md5(string_agg(node || '/0/0', ' ' ORDER BY pos)) AS trajectory_md5 FROM steps GROUP BY user_id, week",
    "snk02_grounding": f"WITH {STEPS} SELECT user_id || '_' || week AS instr_id, CAST(CASE WHEN user_id % 3 <> 0 THEN user_id ELSE 0 END AS INTEGER) AS \"predObjId\" FROM steps GROUP BY user_id, week",
    "snk03_search": f"WITH {STEPS} SELECT CAST(week AS INTEGER) AS instr_id, CASE WHEN user_id % 2 = 0 THEN 0.5 ELSE 0.0 END AS obj_heading, CASE WHEN user_id % 2 = 0 THEN 0.25 ELSE 0.0 END AS obj_elevation, count(*) AS n FROM steps GROUP BY user_id, week",
    "snk04_dialog": f"WITH {STEPS} SELECT instr_id, CAST(any_value(week) AS INTEGER) AS instr_idx, CAST(any_value(week) AS INTEGER) AS inst_idx, count(*) AS n FROM steps GROUP BY 1",
    "snk06_questions": "SELECT item_id, text AS answer, 0 AS n_boxes FROM benchmark",
    "snk09_graph_json": f"WITH {EDGES} SELECT n.scan, n.k AS n_nodes, count(e.src) AS n_edges, CAST(coalesce(sum(e.src * 3 + e.dst), 0) AS BIGINT) AS checksum FROM (SELECT scan, count(*) AS k FROM nodes GROUP BY 1) n LEFT JOIN edges e USING (scan) GROUP BY 1, 2",
}
