"""Graph and trajectory queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.operators import graph, trajectory
from trailweave.plans.base_sql import DIST, EDGES, NODES, STEPS, WALKED
from trailweave.sources import views
from trailweave.sources.durable import durable

#: The benchmark's space is a unit cube, so the success margin of 3 metres is scaled to it.
SCALE = 10.0


def _six(*names: str) -> list[Column]:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def _metres(dist: DataFrame) -> DataFrame:
    return dist.withColumn("d", F.col("d") * SCALE)


def _walks(spark: SparkSession, sf: str, ends: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distances asked for, predictions and viewpoints, each made once and kept: scores read them many times.

    Distances are of the pairs that scores ask for: steps, and from each node to its goal and, if there are any,
    to the first ``ends`` viewpoints of the scan.
    """
    e = durable(views.edges(spark, sf))
    picks = durable(views.picks(spark, sf, graph.reached(e, views.nodes(spark, sf))))
    p = durable(views.predictions(spark, sf, picks))
    ways, goals = p.select("scan", F.flatten("trajectory").alias("way"), "goal"), ["goal"]
    if ends:
        ways, goals = ways.join(_ends(picks, ends), "scan"), ["goal", "end_panos"]
    asked = trajectory.asked_pairs(ways, "way", *goals).unionByName(p.select("scan", F.col("goal").alias("src"), F.col("goal").alias("dst")))
    return durable(graph.asked_distances(e, asked)), p, picks


def _ends(picks: DataFrame, n: int) -> DataFrame:
    """(scan, end_panos): the first viewpoints of each scan."""
    return picks.where(F.col("k") < n).groupBy("scan").agg(F.array_sort(F.collect_list("vp")).alias("end_panos"))


def _inputs(d: DataFrame, p: DataFrame, *_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Predictions, ground truth and distances in metres."""
    return p.drop("scan", "goal"), p.select("instr_id", "scan", F.array(F.flatten("trajectory")[0], "goal").alias("path")), _metres(d)


def agg06_distinct_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Scans of the annotations, with how many rows name each."""
    return views.nodes(spark, sf).groupBy("scan").agg(F.count(F.lit(1)).alias("n_rows"))


def grf01_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Both directions of every edge; checked to be symmetric."""
    return graph.checked_symmetric(views.edges(spark, sf)).select("scan", "src", "dst", *_six("w"))


def jon06_connectivity(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from boolean adjacency rows: viewpoints are included if even, and see those at an even distance in number."""
    n = views.nodes(spark, sf)
    order = n.groupBy("scan").agg(F.array_sort(F.collect_list("vp")).alias("vps"))
    rows = n.join(order, "scan").select(
        "scan", "vp", "x", "y", "z", (F.array_position("vps", F.col("vp")) - 1).cast("int").alias("pos"), (F.col("vp") % 2 == 0).alias("included"),
        F.transform("vps", lambda v: (F.abs(v - F.col("vp")) % 3 == 0)).alias("unobstructed"),
    )
    return graph.connectivity_edges(rows).select("scan", "src", "dst", *_six("w"))


def grf02_distances(spark: SparkSession, sf: str) -> DataFrame:
    """All-pairs shortest distances."""
    return views.dist(spark, sf).select("scan", "src", "dst", *_six("d"))


def grf02_distances_by_joins(spark: SparkSession, sf: str) -> DataFrame:
    """The same by min-plus joins, for scans of any size."""
    return graph.min_plus_distances(views.edges(spark, sf), views.nodes(spark, sf)).select("scan", "src", "dst", *_six("d"))


def grf03_paths(spark: SparkSession, sf: str) -> DataFrame:
    """All-pairs shortest paths as node lists, of up to ten nodes in the oracle's reach."""
    p = graph.paths(views.edges(spark, sf), views.nodes(spark, sf))
    return p.select("scan", "src", "dst", "hops", F.array_join(F.transform("path", lambda v: v.cast("string")), ">").alias("path"))


def grf03_asked_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Shortest paths from where each trajectory starts to its goal, and nothing but those."""
    e, asked = _asked(spark, sf)
    return _as_rows(graph.asked_paths(e, asked))


def grf03_asked_paths_by_joins(spark: SparkSession, sf: str) -> DataFrame:
    """The same by labels that spread from the asked sources through joins: the form for scans that no task can hold."""
    e, asked = _asked(spark, sf)
    return _as_rows(graph.asked_paths(e, asked, most_edges=0))


def _asked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = durable(views.edges(spark, sf))
    p = views.predictions(spark, sf, views.picks(spark, sf, graph.reached(e, views.nodes(spark, sf))))
    return e, p.select("scan", F.flatten("trajectory")[0].alias("src"), F.col("goal").alias("dst"))


def _as_rows(p: DataFrame) -> DataFrame:
    return p.select("scan", "src", "dst", "hops", *_six("d"), F.array_join(F.transform("path", lambda v: v.cast("string")), ">").alias("path"))


def grf_degree(spark: SparkSession, sf: str) -> DataFrame:
    """Degree and nearest neighbour of every viewpoint that has any."""
    return graph.degree(views.edges(spark, sf)).select("scan", "vp", "degree", *_six("nearest"))


ITEM = ("nav_error", "oracle_error", "trajectory_lengths", "gt_lengths", "success", "oracle_success", "spl")


def trj_r2r_items(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of every trajectory against its goal."""
    s = trajectory.score_to_goal(*_inputs(*_walks(spark, sf)))
    return s.select("instr_id", F.col("action_steps").cast("long").alias("action_steps"), F.col("trajectory_steps").cast("long").alias("trajectory_steps"), *_six(*ITEM))


def trj_r2r_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mean scores over all trajectories."""
    return trajectory.summary(trajectory.score_to_goal(*_inputs(*_walks(spark, sf)))).select(*_six("action_steps", "steps", "lengths", "nav_error", "oracle_error", "sr", "oracle_sr", "spl"))


def trj_eqa_summary_by_week(spark: SparkSession, sf: str) -> DataFrame:
    """Mean scores by week (per-group running means)."""
    s = trajectory.score_to_goal(*_inputs(*_walks(spark, sf)))
    return trajectory.summary(s, ["week"]).select("week", *_six("steps", "lengths", "nav_error", "sr", "spl"))


def agg18_steps(spark: SparkSession, sf: str) -> DataFrame:
    """How many trajectories have 1, 2, 3 or more steps, and the share that stops at the start."""
    p = views.predictions(spark, sf).withColumn("n", F.size("trajectory"))
    return p.agg(
        F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") == 2).alias("two"), F.count_if(F.col("n") >= 3).alias("more"),
        F.round(F.avg((F.col("n") == 1).cast("double")), 6).alias("stop_rate"),
    )


def _objects(picks: DataFrame) -> DataFrame:
    """(objid, scan, goal_vps): each scan's viewpoints that are the goal's number modulo seven."""
    return picks.groupBy("scan", (F.col("k") % 7).alias("objid")).agg(F.array_sort(F.collect_list("vp")).alias("goal_vps"))


def trj_reverie_items(spark: SparkSession, sf: str) -> DataFrame:
    """Success in a set of viewpoints, and grounding of the object."""
    d, p, picks = _walks(spark, sf)
    preds, gt, dist = _inputs(d, p)
    preds = preds.withColumn("pred_objid", (F.col("user_id") + F.col("week")) % 7)
    goal_k = picks.select("scan", F.col("vp").alias("goal"), (F.col("k") % 7).alias("objid"))
    gt = gt.withColumn("goal", F.element_at("path", -1)).join(goal_k, ["scan", "goal"]).join(_objects(picks), ["scan", "objid"]).drop("goal")
    s = trajectory.score_in_set(preds, gt, dist)
    return s.select("instr_id", *_six("trajectory_lengths", "success", "oracle_success", "spl", "rgs", "rgspl"))


def trj_soon_items(spark: SparkSession, sf: str) -> DataFrame:
    """Detection inside a box (a square of 0.2 around the goal's direction), seen from viewpoints on the way that have an even id."""
    d, p, _ = _walks(spark, sf)
    preds, gt, dist = _inputs(d, p)
    preds = preds.withColumn("obj_heading", F.when(F.col("user_id") % 5 != 0, (F.col("user_id") % 9) / 20.0)).withColumn("obj_elevation", (F.col("week") % 7) / 20.0)
    corner = [(-0.1, 0.1), (0.1, 0.1), (0.1, -0.1), (-0.1, -0.1)]
    head, elev = (F.element_at("path", -1) % 9) / 20.0, (F.element_at("path", -1) % 7) / 20.0
    corners = F.array(*(F.struct((head + a).alias("heading"), (elev + b).alias("elevation")) for a, b in corner))
    even = F.filter(F.array_distinct(F.flatten("trajectory")), lambda v: v % 2 == 0)
    boxes = F.transform("even", lambda v: F.struct(v.alias("vp"), head.alias("heading"), elev.alias("elevation"), corners.alias("corners")))
    gt = gt.join(p.select("instr_id", even.alias("even")), "instr_id").withColumn("boxes", boxes).drop("even")
    s = trajectory.score_detection(preds, gt, dist)
    return s.select("instr_id", *_six("heading_error", "point_det_error", "det_success", "goal_progress", "success", "spl", "det_spl"))


def _dialog_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d, p, picks = _walks(spark, sf, 3)
    preds, gt, dist = _inputs(d, p)
    return preds, gt.join(_ends(picks, 3), "scan").withColumn("planner_path", F.array(F.col("path")[0], F.col("end_panos")[0])), dist


def trj_cvdn_items(spark: SparkSession, sf: str) -> DataFrame:
    """Dialog navigation towards a set of end panoramas."""
    s = trajectory.score_dialog(*_dialog_inputs(spark, sf))
    return s.select("instr_id", *_six("nav_error", "oracle_error", "oracle_plan_error", "dist_to_end_reduction", "trajectory_lengths", "shortest_path_length", "success", "spl"))


def trj_cvdn_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Rates within the margin and mean goal progress."""
    s = trajectory.dialog_summary(trajectory.score_dialog(*_dialog_inputs(spark, sf)))
    return s.select(*_six("lengths", "nav_error", "oracle_sr", "sr", "spl", "oracle_path_sr", "dist_to_end_reduction"))


def top04_retarget(spark: SparkSession, sf: str) -> DataFrame:
    """Paths that end outside their end panoramas, led to the one of fewest hops."""
    _, gt, _ = _dialog_inputs(spark, sf)
    asked = gt.select("scan", F.col("path")[0].alias("src"), F.explode("end_panos").alias("dst"))
    made = trajectory.retargeted(gt.select("instr_id", "scan", "path", "end_panos"), graph.asked_paths(views.edges(spark, sf), asked))
    return made.select("instr_id", F.element_at("path", -1).alias("goal"))


def agg16_overall(spark: SparkSession, sf: str) -> DataFrame:
    """The score by which checkpoints are compared: each task's rate over its norm."""
    # fixed values: each task's norm
    norms = {0: 60.0, 1: 36.63, 2: 26.58}
    s = trajectory.score_to_goal(*_inputs(*_walks(spark, sf))).withColumn("task", F.col("user_id") % 4)
    by_task = s.groupBy("task").agg((F.avg("spl") * 100).alias("spl"))
    share = F.coalesce(*(F.when(F.col("task") == k, F.col("spl") / v) for k, v in norms.items()), F.lit(0.0))
    return by_task.agg(F.round(F.sum(share), 6).alias("overall"))


QUERIES = {
    f.__name__: f
    for f in (
        agg06_distinct_scans, grf01_edges, jon06_connectivity, grf02_distances, grf02_distances_by_joins, grf03_paths, grf03_asked_paths, grf03_asked_paths_by_joins, grf_degree, trj_r2r_items, trj_r2r_summary,
        trj_eqa_summary_by_week, agg18_steps, trj_reverie_items, trj_soon_items, trj_cvdn_items, trj_cvdn_summary, top04_retarget, agg16_overall,
    )
}

_M = f"* {SCALE}"
_SCORED = f"""{WALKED},
scored AS (
  SELECT *, n - 1 AS action_steps, nav_error {_M} AS ne, oracle_error {_M} AS oe, trajectory_lengths {_M} AS tl, gt_lengths {_M} AS gl,
         CASE WHEN nav_error {_M} < 3 THEN 1.0 ELSE 0.0 END AS won, CASE WHEN oracle_error {_M} < 3 THEN 1.0 ELSE 0.0 END AS owon
  FROM walked),
final AS (SELECT *, gl / greatest(tl, gl, 0.01) AS eff FROM scored)"""
_ENDS = f"""{_SCORED},
ends AS (SELECT scan, vp, k FROM picks WHERE k < 3),
to_ends AS (
  SELECT f.instr_id, min(a.d) {_M} AS before, min(b.d) {_M} AS after
  FROM final f JOIN ends e ON e.scan = f.scan
  JOIN dist a ON a.scan = f.scan AND a.src = f.first_node AND a.dst = e.vp
  JOIN dist b ON b.scan = f.scan AND b.src = f.last_node AND b.dst = e.vp GROUP BY 1),
plan AS (
  SELECT s.instr_id, min(d.d) {_M} AS ope FROM steps s JOIN ends e ON e.scan = s.scan AND e.k = 0
  JOIN dist d ON d.scan = s.scan AND d.src = s.node AND d.dst = e.vp GROUP BY 1)"""
_PATHS = f"""{DIST},
via AS (
  SELECT d.scan, d.src, e.dst, e.src AS mid, d.d + e.w AS total FROM dist d JOIN edges e ON e.scan = d.scan AND e.src = d.dst),
least AS (SELECT scan, src, dst, min(total) AS total FROM via GROUP BY 1, 2, 3),
before AS MATERIALIZED (
  SELECT v.scan, v.src, v.dst, min(v.mid) AS mid FROM via v JOIN least l USING (scan, src, dst) WHERE v.total <= l.total + 1e-12 GROUP BY 1, 2, 3),
ways(scan, src, dst, cur, path, hops) AS (
  SELECT scan, src, dst, dst, CAST(dst AS VARCHAR), 0 FROM dist
  UNION ALL
  SELECT w.scan, w.src, w.dst, b.mid, b.mid || '>' || w.path, w.hops + 1 FROM ways w JOIN before b ON b.scan = w.scan AND b.src = w.src AND b.dst = w.cur WHERE w.cur <> w.src)"""

ORACLE = {
    "agg06_distinct_scans": f"WITH {NODES} SELECT scan, count(*) AS n_rows FROM nodes GROUP BY 1",
    "grf01_edges": f"WITH {EDGES} SELECT scan, src, dst, round(w, 6) AS w FROM edges",
    "jon06_connectivity": f"""WITH {NODES}
SELECT a.scan, a.vp AS src, b.vp AS dst, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)), 6) AS w
FROM nodes a JOIN nodes b ON a.scan = b.scan AND a.vp <> b.vp
WHERE a.vp % 2 = 0 AND b.vp % 2 = 0 AND abs(a.vp - b.vp) % 3 = 0""",
    "grf02_distances": f"WITH {DIST} SELECT scan, src, dst, round(d, 6) AS d FROM dist",
    "grf02_distances_by_joins": f"WITH {DIST} SELECT scan, src, dst, round(d, 6) AS d FROM dist",
    "grf03_paths": f"WITH RECURSIVE {_PATHS} SELECT scan, src, dst, hops, path FROM ways WHERE cur = src",
    "grf_degree": f"WITH {EDGES} SELECT scan, src AS vp, count(*) AS degree, round(min(w), 6) AS nearest FROM edges GROUP BY 1, 2",
    "trj_r2r_items": f"""WITH {_SCORED}
SELECT instr_id, action_steps, action_steps AS trajectory_steps, round(ne, 6) AS nav_error, round(oe, 6) AS oracle_error, round(tl, 6) AS trajectory_lengths,
       round(gl, 6) AS gt_lengths, won AS success, owon AS oracle_success, round(won * eff, 6) AS spl FROM final""",
    "trj_r2r_summary": f"""WITH {_SCORED}
SELECT round(avg(action_steps), 6) AS action_steps, round(avg(action_steps), 6) AS steps, round(avg(tl), 6) AS lengths, round(avg(ne), 6) AS nav_error,
       round(avg(oe), 6) AS oracle_error, round(avg(won) * 100, 6) AS sr, round(avg(owon) * 100, 6) AS oracle_sr, round(avg(won * eff) * 100, 6) AS spl FROM final""",
    "trj_eqa_summary_by_week": f"""WITH {_SCORED}
SELECT week, round(avg(action_steps), 6) AS steps, round(avg(tl), 6) AS lengths, round(avg(ne), 6) AS nav_error, round(avg(won) * 100, 6) AS sr,
       round(avg(won * eff) * 100, 6) AS spl FROM final GROUP BY week""",
    "agg18_steps": f"""WITH {WALKED}
SELECT count(*) FILTER (n = 1) AS one, count(*) FILTER (n = 2) AS two, count(*) FILTER (n >= 3) AS more, round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS stop_rate
FROM walked""",
    "trj_reverie_items": f"""WITH {_SCORED},
goals AS (SELECT f.*, g.k % 7 AS objid, l.k % 7 AS at_end, (SELECT max(CASE WHEN p.k % 7 = g.k % 7 THEN 1.0 ELSE 0.0 END) FROM steps s JOIN picks p ON p.scan = s.scan AND p.vp = s.node WHERE s.instr_id = f.instr_id) AS ow
  FROM final f JOIN picks g ON g.scan = f.scan AND g.vp = f.goal JOIN picks l ON l.scan = f.scan AND l.vp = f.last_node),
r AS (SELECT *, CASE WHEN at_end = objid THEN 1.0 ELSE 0.0 END AS w, CASE WHEN (user_id + week) % 7 = objid THEN 1.0 ELSE 0.0 END AS rg FROM goals)
SELECT instr_id, round(tl, 6) AS trajectory_lengths, w AS success, ow AS oracle_success, round(w * eff, 6) AS spl, rg AS rgs, round(rg * eff, 6) AS rgspl FROM r""",
    "trj_soon_items": f"""WITH {_SCORED},
p AS (SELECT *, CASE WHEN user_id % 5 <> 0 THEN (user_id % 9) / 20.0 END AS h, (week % 7) / 20.0 AS e, (goal % 9) / 20.0 AS gh, (goal % 7) / 20.0 AS ge, last_node % 2 = 0 AND user_id % 5 <> 0 AS seen FROM final),
q AS (SELECT *, CASE WHEN seen AND h > gh - 0.1 AND h < gh + 0.1 AND e > ge - 0.1 AND e < ge + 0.1 THEN 1.0 ELSE 0.0 END AS hit FROM p)
SELECT instr_id, CASE WHEN seen THEN round(abs(gh - h), 6) END AS heading_error, CASE WHEN seen THEN round(sqrt((gh-h)*(gh-h) + (ge-e)*(ge-e)), 6) END AS point_det_error,
       hit AS det_success, round(gl - ne, 6) AS goal_progress, won AS success, round(won * eff, 6) AS spl, round(hit * eff, 6) AS det_spl FROM q""",
    "trj_cvdn_items": f"""WITH {_ENDS}
SELECT f.instr_id, round(ne, 6) AS nav_error, round(oe, 6) AS oracle_error, round(ope, 6) AS oracle_plan_error, round(before - after, 6) AS dist_to_end_reduction,
       round(tl, 6) AS trajectory_lengths, round(gl, 6) AS shortest_path_length, won AS success, round(won * eff, 6) AS spl
FROM final f JOIN to_ends USING (instr_id) JOIN plan USING (instr_id)""",
    "trj_cvdn_summary": f"""WITH {_ENDS}
SELECT round(avg(tl), 6) AS lengths, round(avg(ne), 6) AS nav_error, round(avg(owon) * 100, 6) AS oracle_sr, round(avg(won) * 100, 6) AS sr, round(avg(won * eff) * 100, 6) AS spl,
       round(avg(CASE WHEN ope < 3 THEN 1.0 ELSE 0.0 END) * 100, 6) AS oracle_path_sr, round(avg(before - after), 6) AS dist_to_end_reduction
FROM final f JOIN to_ends USING (instr_id) JOIN plan USING (instr_id)""",
    "top04_retarget": f"""WITH RECURSIVE {_PATHS.replace(DIST, STEPS)},
firsts AS (SELECT instr_id, any_value(scan) AS scan, arg_min(node, pos) AS src, any_value(goal) AS goal FROM steps GROUP BY 1),
ends AS (SELECT scan, vp FROM picks WHERE k < 3),
hops AS (SELECT scan, src, dst, hops FROM ways WHERE cur = src),
best AS (SELECT f.instr_id, arg_min(e.vp, h.hops * 1000000 + e.vp) AS vp FROM firsts f JOIN ends e ON e.scan = f.scan JOIN hops h ON h.scan = f.scan AND h.src = f.src AND h.dst = e.vp GROUP BY 1)
SELECT f.instr_id, CASE WHEN EXISTS (SELECT 1 FROM ends e WHERE e.scan = f.scan AND e.vp = f.goal) THEN f.goal ELSE b.vp END AS goal FROM firsts f JOIN best b USING (instr_id)""",
    "agg16_overall": f"""WITH {_SCORED},
t AS (SELECT user_id % 4 AS task, avg(won * eff) * 100 AS spl FROM final GROUP BY 1)
SELECT round(sum(CASE task WHEN 0 THEN spl / 60.0 WHEN 1 THEN spl / 36.63 WHEN 2 THEN spl / 26.58 ELSE 0.0 END), 6) AS overall FROM t""",
}

_ASKED = f"""WITH RECURSIVE {_PATHS.replace(DIST, STEPS, 1)},
asked AS (SELECT DISTINCT scan, first(node ORDER BY pos) AS src, any_value(goal) AS dst FROM steps GROUP BY instr_id, scan)
SELECT w.scan, w.src, w.dst, w.hops, round(d.d, 6) AS d, w.path FROM ways w JOIN asked a USING (scan, src, dst) JOIN dist d USING (scan, src, dst) WHERE w.cur = w.src"""
ORACLE |= {"grf03_asked_paths": _ASKED, "grf03_asked_paths_by_joins": _ASKED}
