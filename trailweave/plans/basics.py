"""Small operators one by one: look-ups, fusion, running means, text and JSON helpers, memory upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.functions import arrays, geometry
from trailweave.operators import annotate, candidates, memory, sampling
from trailweave.plans.base_sql import EDGES, NODES, PICKS, STEPS, stripped_sql, words_sql
from trailweave.sources import annotations, views
from trailweave.sources.spread import spread
from trailweave.sources.tables import table


def flt03_included_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose both ends are included (every viewpoint but multiples of seven)."""
    keep = lambda c: F.col(c) % 7 != 0
    return views.edges(spark, sf).where(keep("src") & keep("dst")).groupBy("scan").agg(F.count(F.lit(1)).alias("n_edges"))


def flt06_one_way_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges that go one way only, once those from even to odd viewpoints are taken out: what the symmetry check would raise for."""
    e = views.edges(spark, sf).select("scan", "src", "dst").where("NOT (src % 2 = 0 AND dst % 2 = 1)")
    back = e.select("scan", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["scan", "src", "dst"], "left_anti")


def flt01_ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Trajectories with more than one step are ground truth."""
    p = views.predictions(spark, sf)
    return p.where(F.size("trajectory") > 1).select("instr_id", F.size("trajectory").alias("n"))


def flt09_finite(spark: SparkSession, sf: str) -> DataFrame:
    """Values that are not finite become 0."""
    v = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 10 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    e = table(spark, sf, "events").select("event_id", F.array(v, F.col("value")).alias("v"))
    fixed = F.transform("v", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))
    return e.select("event_id", fixed[0].alias("first"), fixed[1].alias("second"))


def jon05_question_images(spark: SparkSession, sf: str) -> DataFrame:
    """Questions (scans) with their images' features, in the images' order."""
    s = views.nodes(spark, sf).groupBy("scan").agg(F.array_sort(F.collect_list("vp")).alias("images"))
    each = s.select("scan", F.posexplode("images").alias("pos", "vp"))
    store = views.nodes(spark, sf).select("scan", "vp", F.col("x").alias("f"))
    got = each.join(store, ["scan", "vp"]).groupBy("scan").agg(F.array_sort(F.collect_list(F.struct("pos", "f"))).alias("l"))
    return got.select("scan", F.round(F.aggregate("l", F.lit(0.0), lambda a, x: a + x["f"] * (x["pos"] + 1)), 6).alias("features"))


def jon10_at_goal(spark: SparkSession, sf: str) -> DataFrame:
    """Trajectories that end in one of their scan's first three viewpoints (a semi join)."""
    p = views.predictions(spark, sf).select("instr_id", "scan", F.element_at(F.flatten("trajectory"), -1).alias("vp"))
    return p.join(views.picks(spark, sf).where("k < 3").select("scan", "vp"), ["scan", "vp"], "left_semi").select("instr_id")


def jon12_fused(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates fused into a graph's nodes: a match adds to the node's score, others come in with type 1."""
    c = views.edges(spark, sf).groupBy("scan", F.col("dst").alias("vp")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    g = views.nodes(spark, sf).where("vp % 3 = 0").select("scan", "vp", F.round("x", 6).alias("own"))
    r = c.join(g, ["scan", "vp"], "left")
    return r.select("scan", "vp", F.round(F.col("score") + F.coalesce("own", F.lit(0.0)), 6).alias("score"), F.col("own").isNull().cast("int").alias("type"))


def agg07_running_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean value of every task so far, at each event; nothing yet counts as 0."""
    e = annotate.running_sums(table(spark, sf, "events"), ["event_type"], "event_id", "value")
    return e.select("event_id", F.round(F.coalesce(F.try_divide("sum_before", "n_before"), F.lit(0.0)) * F.col("n_before"), 3).alias("mean_times_n"))


def agg10_node_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Each viewpoint's embedding over its visits: mean and maximum of the values seen; visits marked as rewriting begin anew."""
    s = views.steps(spark, sf).withColumn("v", ((F.col("pos") * 7 + F.col("week")) % 11).cast("double")).withColumn("rewrite", (F.col("pos") % 5 == 4).cast("int"))
    w = Window.partitionBy("instr_id", "node").orderBy("pos")
    s = s.withColumn("era", F.sum("rewrite").over(w))
    last = s.groupBy("instr_id", "node", "era").agg(F.avg("v").alias("mean"), F.max("v").alias("most"), F.count(F.lit(1)).alias("n"))
    return last.groupBy("instr_id", "node").agg(F.max_by(F.struct("mean", "most", "n"), "era").alias("e")).select("instr_id", "node", F.round("e.mean", 6).alias("mean"), "e.most", "e.n")


def arr06_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """A permutation of each scan's viewpoints by hashes, and its inverse put back: the identity."""
    s = views.nodes(spark, sf).groupBy("scan").agg(F.array_sort(F.collect_list("vp")).alias("v"))
    s = s.withColumn("p", sampling.sampled("v", 1_000_000, 4, "scan"))
    back = F.transform("v", lambda x: F.array_position("p", x))
    return s.select("scan", F.size("v").alias("n"), F.md5(F.array_join(F.transform("p", lambda x: x.cast("string")), ",")).alias("order_md5"), (F.transform(back, lambda k: F.element_at("p", k.cast("int"))) == F.col("v")).alias("restored"))


def arr07_pair_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of the distances among each trajectory's distinct viewpoints."""
    d = views.dist(spark, sf)
    s = views.steps(spark, sf, views.picks(spark, sf, views.reach_of(d))).select("instr_id", "scan", "node").distinct()
    pairs = s.join(s.select("instr_id", F.col("node").alias("other")), "instr_id").where("node < other")
    near = d.select("scan", F.col("src").alias("node"), F.col("dst").alias("other"), "d")
    return pairs.join(near, ["scan", "node", "other"]).groupBy("instr_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.sum("d"), 5).alias("total"))


def jsn01_properties(spark: SparkSession, sf: str) -> DataFrame:
    """A number out of each event's JSON, a default where it is absent, and the record as JSON again."""
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,int>").alias("m"))
    k = F.coalesce(F.try_element_at("m", F.lit("k")), F.lit(-1))
    return e.select("event_id", k.alias("k"), F.coalesce(F.try_element_at("m", F.lit("nope")), F.lit(-1)).alias("nope"), F.to_json(F.struct(k.alias("k"))).alias("json"))


def mth15_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Additive masks of turns padded to the longest of their conversation."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.size(arrays.words("text")).alias("n"))
    t = t.withColumn("most", F.max("n").over(Window.partitionBy("conv_id")))
    m = geometry.pairwise_mask(F.transform(F.sequence(F.lit(1), F.greatest("most", F.lit(1))), lambda k: k <= F.col("n")))
    return t.select("conv_id", "turn", F.aggregate(m, F.lit(0.0), lambda a, x: a + x).alias("total"))


def obs03_types(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed type mask of all views: a ring of ones, the rest zeros; and the fields of joined keys."""
    mask = F.concat(F.array_repeat(F.lit(1), geometry.RING), F.array_repeat(F.lit(0), geometry.VIEWS - geometry.RING))
    scan, vp = annotations.key_parts("key")
    k = views.nodes(spark, sf).select(F.concat_ws("_", F.lit("scan"), "scan", "vp").alias("key"))
    return k.select("key", scan.alias("scan"), vp.alias("vp"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("n_ones"), F.size(mask).alias("n"))


def obs07_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Objects in sight with angles off the viewer's and box features, at most three a supplier."""
    o = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    o = o.withColumn("k", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_partkey"))).where("k <= 3")
    h, e = (F.col("l_partkey") % 13) / 4.0 - 0.5, (F.col("l_partkey") % 5) / 8.0 - 0.25
    f = geometry.angle_feature(h, e)
    b = geometry.box_feature_xywh(F.array(F.lit(0.0), F.lit(0.0), (F.col("l_partkey") % 97 + 0.5), (F.col("l_partkey") % 89 + 0.25)))
    return o.select("l_suppkey", "l_partkey", *(F.round(f[k], 6).alias(f"a{k}") for k in range(4)), F.round(b[2], 9).alias("area"))


def smp05_shuffled(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in the order of hashes of their ids: the place of each, numbered inside ranges of hashes."""
    return sampling.shuffled(table(spark, sf, "documents").select("doc_id"), 9, "doc_id").select("doc_id", "place")


def st02_status(spark: SparkSession, sf: str) -> DataFrame:
    """Status of every viewpoint a trajectory met: visited, its place in the walk (the last write wins) and the step."""
    s = views.steps(spark, sf)
    e = views.edges(spark, sf).select("scan", F.col("src").alias("node"), "dst")
    met = s.select("instr_id", "scan", "node", "pos", F.lit(True).alias("visited")).unionByName(s.join(e, ["scan", "node"]).select("instr_id", "scan", F.col("dst").alias("node"), "pos", F.lit(False).alias("visited")))
    g = spread(met, "instr_id").groupBy("instr_id", "node").agg(F.bool_or("visited").alias("visited"), F.max(F.when(F.col("visited"), F.col("pos"))).alias("traj_order"), F.min("pos").alias("first_seen"))
    return g.groupBy("instr_id").agg(F.count_if("visited").alias("n_visited"), F.count_if(~F.col("visited")).alias("n_seen"), F.sum("traj_order").alias("orders"), F.sum("first_seen").alias("seen"))


def st13_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Scene and object features of a memory's nodes: each written field holds its last value, unwritten ones are null."""
    s = views.steps(spark, sf)
    scene, thing = F.when(F.col("pos") % 2 == 0, F.col("pos")), F.when(F.col("pos") % 3 == 0, F.col("pos") * 10)
    g = s.withColumn("s", scene).withColumn("o", thing).groupBy("instr_id", "node").agg(F.max_by("s", F.when(F.col("s").isNotNull(), F.col("pos"))).alias("s_env"), F.max_by("o", F.when(F.col("o").isNotNull(), F.col("pos"))).alias("d_env"))
    return g


def str03_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in lower case without white space around, yes-or-no words read, ids without prefix."""
    t = table(spark, sf, "conversations")
    word = F.element_at(F.array(F.lit("Yes"), F.lit("no"), F.lit("T"), F.lit("0")), (F.col("turn") % 4 + 1).cast("int"))
    return t.select("conv_id", "turn", F.md5(F.lower(arrays.stripped(F.concat(F.lit(" \n"), "text", F.lit("\t"))))).alias("md5"), arrays.truth(word).alias("truth"), F.regexp_replace(F.concat_ws("_", F.lit("r2r"), "conv_id", "turn"), "^[^_]*_", "").alias("id"))


def obs04_local_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Local options of every viewpoint (stop, then neighbours) with positions relative to the scan's first viewpoint: their sums."""
    n, d = views.nodes(spark, sf), views.dist(spark, sf)
    first = views.picks(spark, sf, views.reach_of(d)).where("k = 0").select("scan", F.col("vp").alias("start"))
    at = lambda s, k: n.select("scan", F.col("vp").alias(k), *(F.col(c).alias(f"{c}{s}") for c in "xyz"))
    point = lambda s: tuple(F.col(f"{c}{s}") for c in "xyz")
    rel = lambda b: geometry.relative_position(point("a"), point(b), F.lit(0.0), F.lit(0.0))
    far = d.select("scan", F.col("src").alias("vp"), F.col("dst").alias("start"), "d")
    base = first.join(far, ["scan", "start"]).join(at("a", "vp"), ["scan", "vp"]).join(at("s", "start"), ["scan", "start"])
    base = base.withColumn("begin", geometry.position_feature(rel("s"), F.col("d"), F.lit(0), F.lit(True)))
    e = views.edges(spark, sf).select("scan", F.col("src").alias("vp"), F.col("dst").alias("nbr"), "w")
    go = base.join(e, ["scan", "vp"]).join(at("b", "nbr"), ["scan", "nbr"]).withColumn("own", geometry.position_feature(rel("b"), F.col("w"), F.lit(1), F.lit(True)))
    rows = go.select("scan", "vp", "nbr", "begin", "own").unionByName(base.select("scan", "vp", F.lit(None).cast("long").alias("nbr"), "begin", F.lit(None).cast("array<double>").alias("own")))
    p = candidates.local_positions(rows, "begin", "own")
    return p.select("scan", "vp", "nbr", F.size("position").alias("size"), F.round(F.aggregate("position", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def st12_pooled(spark: SparkSession, sf: str) -> DataFrame:
    """Node features of walks: visited ones pool their visits, others the sightings from beside."""
    s = views.steps(spark, sf).withColumn("v", (F.col("pos") * 3 + F.col("week") % 5).cast("double"))
    e = views.edges(spark, sf).select("scan", F.col("src").alias("node"), "dst")
    seen = s.join(e, ["scan", "node"]).select("instr_id", F.col("dst").alias("node"), "v")
    p = memory.pooled(s.select("instr_id", "node", "v"), seen, "v")
    return p.groupBy("instr_id", "visited").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mean"), 5).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        flt03_included_edges, flt06_one_way_edges, flt01_ground_truth, flt09_finite, jon05_question_images, jon10_at_goal, jon12_fused, agg07_running_means, agg10_node_embeddings,
        arr06_permutation, arr07_pair_distances, jsn01_properties, mth15_masks, obs03_types, obs07_objects, smp05_shuffled, st02_status, st13_upsert, str03_answers, obs04_local_positions, st12_pooled,
    )
}

_WORDS = words_sql()

ORACLE = {
    "flt03_included_edges": f"WITH {EDGES} SELECT scan, count(*) AS n_edges FROM edges WHERE src % 7 <> 0 AND dst % 7 <> 0 GROUP BY 1",
    "flt06_one_way_edges": f"WITH {EDGES} SELECT scan, src, dst FROM edges WHERE src % 2 = 1 AND dst % 2 = 0",
    "flt01_ground_truth": f"WITH {STEPS} SELECT instr_id, count(*) AS n FROM steps GROUP BY 1 HAVING count(*) > 1",
    "flt09_finite": "SELECT event_id, CASE WHEN event_id % 10 IN (0, 1) THEN 0.0 ELSE value END AS first, value AS second FROM events",
    "jon05_question_images": f"""WITH {NODES}, o AS (SELECT scan, x AS f, row_number() OVER (PARTITION BY scan ORDER BY vp) AS k FROM nodes) SELECT scan, round(sum(f * k), 6) AS features FROM o GROUP BY 1""",
    "jon10_at_goal": f"""WITH {STEPS}, l AS (SELECT instr_id, scan, arg_max(node, pos) AS vp FROM steps GROUP BY 1, 2) SELECT instr_id FROM l WHERE EXISTS (SELECT 1 FROM picks p WHERE p.scan = l.scan AND p.vp = l.vp AND p.k < 3)""",
    "jon12_fused": f"""WITH {EDGES}, c AS (SELECT scan, dst AS vp, count(*) AS score FROM edges GROUP BY 1, 2)
SELECT c.scan, c.vp, round(c.score + coalesce(round(n.x, 6), 0.0), 6) AS score, CASE WHEN n.vp IS NULL THEN 1 ELSE 0 END AS type FROM c LEFT JOIN nodes n ON n.scan = c.scan AND n.vp = c.vp AND n.vp % 3 = 0""",
    "agg07_running_means": "SELECT event_id, round(coalesce(sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 3) AS mean_times_n FROM events",
    "agg10_node_embeddings": f"""WITH {STEPS}, v AS (SELECT *, CAST((pos * 7 + week) % 11 AS DOUBLE) AS v, sum(CASE WHEN pos % 5 = 4 THEN 1 ELSE 0 END) OVER (PARTITION BY instr_id, node ORDER BY pos) AS era FROM steps),
l AS (SELECT *, max(era) OVER (PARTITION BY instr_id, node) AS last FROM v) SELECT instr_id, node, round(avg(v), 6) AS mean, max(v) AS most, count(*) AS n FROM l WHERE era = last GROUP BY 1, 2""",
    "arr06_permutation": f"""WITH {NODES}, p AS (SELECT scan, vp AS vec_id, row_number() OVER (PARTITION BY scan ORDER BY md5('4|' || scan || '|' || vp), vp) AS k FROM nodes)
SELECT scan, count(*) AS n, md5(string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY k)) AS order_md5, true AS restored FROM p GROUP BY 1""",
    "arr07_pair_distances": f"""WITH {STEPS}, s AS (SELECT DISTINCT instr_id, scan, node FROM steps)
SELECT a.instr_id, count(*) AS n_pairs, round(sum(d.d), 5) AS total FROM s a JOIN s b ON a.instr_id = b.instr_id AND a.node < b.node JOIN dist d ON d.scan = a.scan AND d.src = a.node AND d.dst = b.node GROUP BY 1""",
    "jsn01_properties": """WITH e AS (SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INTEGER), -1) AS k FROM events) SELECT event_id, k, -1 AS nope, '{"k":' || k || '}' AS json FROM e""",
    "mth15_masks": f"""WITH t AS (SELECT conv_id, turn, len({_WORDS}) AS n FROM conversations)
SELECT conv_id, turn, -10000.0 * (greatest(max(n) OVER (PARTITION BY conv_id), 1) - n) AS total FROM t""",
    "obs03_types": f"WITH {NODES} SELECT 'scan_' || scan || '_' || vp AS key, 'scan' AS scan, scan || '_' || vp AS vp, 12 AS n_ones, 36 AS n FROM nodes",
    "obs07_objects": """WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS k FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) WHERE k <= 3)
SELECT l_suppkey, l_partkey, round(sin((l_partkey % 13) / 4.0 - 0.5), 6) AS a0, round(cos((l_partkey % 13) / 4.0 - 0.5), 6) AS a1, round(sin((l_partkey % 5) / 8.0 - 0.25), 6) AS a2, round(cos((l_partkey % 5) / 8.0 - 0.25), 6) AS a3,
       round((CAST(l_partkey % 89 AS DOUBLE) + 0.25) / 480 * ((CAST(l_partkey % 97 AS DOUBLE) + 0.5) / 640), 9) AS area FROM o""",
    "smp05_shuffled": "SELECT doc_id, row_number() OVER (ORDER BY substr(md5('9|' || doc_id), 1, 13), doc_id) - 1 AS place FROM documents",
    "st02_status": f"""WITH {STEPS}, m AS (SELECT instr_id, node, pos, true AS visited FROM steps UNION ALL SELECT s.instr_id, e.dst, s.pos, false FROM steps s JOIN edges e ON e.scan = s.scan AND e.src = s.node),
g AS (SELECT instr_id, node, bool_or(visited) AS visited, max(pos) FILTER (visited) AS o, min(pos) AS f FROM m GROUP BY 1, 2)
SELECT instr_id, count(*) FILTER (visited) AS n_visited, count(*) FILTER (NOT visited) AS n_seen, CAST(sum(o) AS BIGINT) AS orders, CAST(sum(f) AS BIGINT) AS seen FROM g GROUP BY 1""",
    "st13_upsert": f"WITH {STEPS} SELECT instr_id, node, max(pos) FILTER (pos % 2 = 0) AS s_env, max(pos * 10) FILTER (pos % 3 = 0) AS d_env FROM steps GROUP BY 1, 2",
    "str03_answers": f"SELECT conv_id, turn, md5(lower({stripped_sql('text')})) AS md5, [true, false, true, false][turn % 4 + 1] AS truth, conv_id || '_' || turn AS id FROM conversations",
}

_SIDE = "asin((b.x-a.x) / greatest(sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y)), 1e-8))"
_HEAD = f"(CASE WHEN b.y < a.y THEN pi() - {_SIDE} ELSE {_SIDE} END)"
_FAR = "greatest(sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z)), 1e-8)"
_ELEV = f"asin((b.z-a.z) / {_FAR})"
_SUM = f"sin({_HEAD}) + cos({_HEAD}) + sin({_ELEV}) + cos({_ELEV}) + {_FAR} / 30"
ORACLE["obs04_local_positions"] = f"""WITH {PICKS},
f AS (SELECT d.scan, d.src AS vp, {_SUM} + d.d / 30 AS t FROM picks p JOIN dist d ON d.scan = p.scan AND d.dst = p.vp AND p.k = 0 JOIN nodes a ON a.scan = d.scan AND a.vp = d.src JOIN nodes b ON b.scan = d.scan AND b.vp = d.dst)
SELECT f.scan, f.vp, e.dst AS nbr, 14 AS size, round(f.t + {_SUM} + e.w / 30 + 0.1, 6) AS total FROM f JOIN edges e ON e.scan = f.scan AND e.src = f.vp JOIN nodes a ON a.scan = f.scan AND a.vp = f.vp JOIN nodes b ON b.scan = f.scan AND b.vp = e.dst
UNION ALL SELECT scan, vp, NULL, 14, round(t, 6) FROM f"""
ORACLE["st12_pooled"] = f"""WITH {STEPS}, v AS (SELECT *, CAST(pos * 3 + week % 5 AS DOUBLE) AS v FROM steps),
own AS (SELECT instr_id, node, avg(v) AS m FROM v GROUP BY 1, 2),
seen AS (SELECT v.instr_id, e.dst AS node, avg(v.v) AS m FROM v JOIN edges e ON e.scan = v.scan AND e.src = v.node WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.instr_id = v.instr_id AND o.node = e.dst) GROUP BY 1, 2)
SELECT instr_id, true AS visited, count(*) AS n, round(sum(m), 5) AS total FROM own GROUP BY 1 UNION ALL SELECT instr_id, false, count(*), round(sum(m), 5) FROM seen GROUP BY 1"""
