"""Scores of predicted trajectories against ground truth, and their summaries.

``preds`` has (instr_id, trajectory array<array<vp>>), ``gt`` (instr_id, scan, path array<vp>) and what a
task needs besides; ``dist`` (scan, src, dst, d) holds the shortest distances. Paths are exploded,
joined with ``dist`` on the goal and on the step before, and aggregated per trajectory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.operators.graph import adjacent_pairs

#: Metres from the goal within which a trajectory succeeds (strictly); a fixed value.
MARGIN = 3.0


def _need(value: Column, ok: Column, message: str) -> Column:
    """``value`` where ``ok``; else reading it raises."""
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(message + " "), F.coalesce(F.col("instr_id").cast("string"), F.lit("null")))))


def matched(preds: DataFrame, gt: DataFrame) -> DataFrame:
    """Predictions with their ground truth; an id without one, or a wrong start, raises."""
    known = gt.withColumn("_known", F.lit(True))
    joined = preds.join(known, "instr_id", "left").withColumn("pred_path", F.flatten("trajectory"))
    checked = _need(F.col("pred_path"), F.coalesce(F.col("_known"), F.lit(False)), "no ground truth for")
    joined = joined.withColumn("pred_path", checked)
    return joined.withColumn("pred_path", _need(F.col("pred_path"), F.col("pred_path")[0] == F.col("path")[0], "wrong start of")).drop("_known")


def offenders(preds: DataFrame, gt: DataFrame) -> DataFrame:
    """(instr_id, why): the predictions at which ``matched`` would raise, ``unknown`` or ``start``; for a look before a long run."""
    known = gt.select("instr_id", F.col("path")[0].alias("_start"), F.lit(True).alias("_known"))
    joined = preds.select("instr_id", F.flatten("trajectory")[0].alias("_first")).join(known, "instr_id", "left")
    why = F.when(F.col("_known").isNull(), "unknown").when(~F.col("_first").eqNullSafe(F.col("_start")), "start")
    return joined.select("instr_id", why.alias("why")).where("why IS NOT NULL")


def walked(paths: DataFrame, dist: DataFrame, path: str, goal: str, *keys: str) -> DataFrame:
    """Per keys (``instr_id`` if none are named) over (keys, scan, ``path``, ``goal``): length, and distance to the goal at the end, at best, and where.

    Of nodes at equal distance the earlier one is nearest. A pair that is not connected raises.
    """
    keys = keys or ("instr_id",)
    steps = paths.select(*keys, "scan", F.col(goal).alias("dst"), F.explode(adjacent_pairs(path)).alias("s")).select(*keys, "scan", "dst", "s.pos", "s.prev", "s.node")
    to_goal = dist.select("scan", F.col("src").alias("node"), "dst", F.col("d").alias("to_goal"))
    one_step = dist.select("scan", F.col("src").alias("prev"), F.col("dst").alias("node"), F.col("d").alias("moved"))
    rows = steps.join(to_goal, ["scan", "node", "dst"], "left").join(one_step, ["scan", "prev", "node"], "left")
    lost = F.col("to_goal").isNull() | (F.col("prev").isNotNull() & F.col("moved").isNull())
    rows = rows.withColumn("to_goal", F.when(~lost, F.col("to_goal")).otherwise(F.raise_error(F.lit("not connected")).cast("double")))
    return rows.groupBy(*keys).agg(
        F.max_by("to_goal", "pos").alias("nav_error"),
        F.min("to_goal").alias("oracle_error"),
        F.min_by("node", F.struct("to_goal", "pos")).alias("nearest"),
        F.min_by("to_goal", "pos").alias("start_error"),
        F.coalesce(F.sum("moved"), F.lit(0.0)).alias("length"),
    )


def asked_pairs(paths: DataFrame, path: str, *goals: str) -> DataFrame:
    """(scan, src, dst): the distances that scoring (scan, ``path``, ``goals``) needs. A goal is a viewpoint or an array of them.

    Every step on the way, and from each node to each goal.
    """
    kinds = dict(paths.dtypes)
    targets = F.concat(*(F.col(g) if kinds[g].startswith("array") else F.array(g) for g in goals))
    steps = paths.select("scan", F.explode(adjacent_pairs(path)).alias("s"), targets.alias("to"))
    moved = steps.select("scan", F.col("s.prev").alias("src"), F.col("s.node").alias("dst")).where("src IS NOT NULL")
    return moved.unionByName(steps.select("scan", F.col("s.node").alias("src"), F.explode("to").alias("dst"))).distinct()


def _spl(won: Column) -> Column:
    return won * F.col("gt_lengths") / F.greatest("trajectory_lengths", "gt_lengths", F.lit(0.01))


def base_scores(preds: DataFrame, gt: DataFrame, dist: DataFrame) -> DataFrame:
    """Everything the tasks share: both paths walked, together; keeps the columns of ``matched``."""
    m = matched(preds, gt).withColumn("goal", F.element_at("path", -1))
    ways = F.array(F.struct(F.lit(True).alias("own"), F.col("pred_path").alias("way")), F.struct(F.lit(False).alias("own"), F.col("path").alias("way")))
    both = m.select("instr_id", "scan", "goal", F.explode(ways).alias("w")).select("instr_id", "scan", "goal", "w.own", "w.way")
    each = walked(both, dist, "way", "goal", "instr_id", "own")
    of = lambda own, c: F.max(F.when(F.col("own") == own, F.col(c)))  # noqa: E731  (one row of each kind)
    measured = each.groupBy("instr_id").agg(
        *(of(True, c).alias(c) for c in ("nav_error", "oracle_error", "nearest", "start_error")), of(True, "length").alias("trajectory_lengths"),
        of(False, "length").alias("gt_lengths"), of(False, "start_error").alias("start_to_goal"),
    )
    return m.join(measured, "instr_id").withColumn("action_steps", F.size("trajectory") - 1).withColumn("trajectory_steps", F.size("pred_path") - 1)


def score_to_goal(preds: DataFrame, gt: DataFrame, dist: DataFrame) -> DataFrame:
    """Instruction following and embodied questions: success within MARGIN of the goal."""
    s = base_scores(preds, gt, dist)
    s = s.withColumn("success", (F.col("nav_error") < MARGIN).cast("double")).withColumn("oracle_success", (F.col("oracle_error") < MARGIN).cast("double"))
    return s.withColumn("spl", _spl(F.col("success")))


def score_in_set(preds: DataFrame, gt: DataFrame, dist: DataFrame) -> DataFrame:
    """Remote grounding: success in a goal viewpoint (gt: ``goal_vps``), and the right object (``pred_objid``, ``objid``).

    Grounding counts whether or not the agent arrived. Ids are compared as text; two absent ones are equal.
    """
    s = base_scores(preds, gt, dist)
    s = s.withColumn("success", F.array_contains("goal_vps", F.element_at("pred_path", -1)).cast("double"))
    s = s.withColumn("oracle_success", F.arrays_overlap("goal_vps", "pred_path").cast("double"))
    s = s.withColumn("rgs", F.col("pred_objid").cast("string").eqNullSafe(F.col("objid").cast("string")).cast("double"))
    return s.withColumn("spl", _spl(F.col("success"))).withColumn("rgspl", _spl(F.col("rgs")))


def inside_polygon(x: Column, y: Column, corners: list[tuple[Column, Column]]) -> Column:
    """Whether a point is strictly inside a polygon (ray casting; its edges are outside)."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        spans = (ay > y) != (by > y)
        at = ax + (y - ay) * (bx - ax) / F.when(by == ay, F.lit(None)).otherwise(by - ay)
        crossings = crossings + F.coalesce((spans & (x < at)).cast("int"), F.lit(0))
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        between = (x >= F.least(ax, bx)) & (x <= F.greatest(ax, bx)) & (y >= F.least(ay, by)) & (y <= F.greatest(ay, by))
        on_edge = on_edge | ((cross == 0) & between)
    return (crossings % 2 == 1) & ~on_edge


def score_detection(preds: DataFrame, gt: DataFrame, dist: DataFrame) -> DataFrame:
    """Object search: success near the goal, and a direction inside the target's box seen from where the agent stopped.

    preds: ``obj_heading``, ``obj_elevation``; gt: ``boxes array<struct<vp, heading, elevation, corners
    array<struct<heading, elevation>>>>``. The ground-truth length is the distance from start to goal.
    """
    s = base_scores(preds, gt, dist).withColumn("gt_lengths", F.col("start_to_goal"))
    box = F.filter("boxes", lambda b: b["vp"] == F.element_at("pred_path", -1))
    s = s.withColumn("_box", F.try_element_at(box, F.lit(-1)))  # of boxes for one viewpoint the last counts
    seen = F.col("_box").isNotNull() & F.col("obj_heading").isNotNull() & F.col("obj_elevation").isNotNull()
    dh, de = F.col("_box.heading") - F.col("obj_heading"), F.col("_box.elevation") - F.col("obj_elevation")
    corners = [(F.col("_box.corners")[k]["heading"], F.col("_box.corners")[k]["elevation"]) for k in range(4)]
    s = s.withColumn("heading_error", F.when(seen, F.abs(dh))).withColumn("elevation_error", F.when(seen, F.abs(de)))
    s = s.withColumn("point_det_error", F.when(seen, F.hypot(dh, de)))
    hit = F.when(seen, inside_polygon(F.col("obj_heading"), F.col("obj_elevation"), corners)).otherwise(False)
    s = s.withColumn("det_success", hit.cast("double")).drop("_box")
    s = s.withColumn("success", (F.col("nav_error") < MARGIN).cast("double")).withColumn("oracle_success", (F.col("oracle_error") < MARGIN).cast("double"))
    s = s.withColumn("goal_progress", F.col("start_to_goal") - F.col("nav_error"))
    return s.withColumn("spl", _spl(F.col("success"))).withColumn("det_spl", _spl(F.col("det_success")))


def nearest_of_set(rows: DataFrame, dist: DataFrame, nodes: dict[str, str], targets: str, key: str = "instr_id") -> DataFrame:
    """(key, outs): the least distance from each of some nodes (out -> its column) to any of ``targets``."""
    starts = F.array(*(F.struct(F.lit(out).alias("out"), F.col(c).alias("src")) for out, c in nodes.items()))
    each = rows.select(key, "scan", targets, F.explode(starts).alias("s")).select(key, "scan", "s.out", "s.src", F.explode(targets).alias("dst"))
    met = each.join(dist, ["scan", "src", "dst"])
    return met.groupBy(key).agg(*(F.min(F.when(F.col("out") == out, F.col("d"))).alias(out) for out in nodes))


def score_dialog(preds: DataFrame, gt: DataFrame, dist: DataFrame) -> DataFrame:
    """Dialog navigation (gt: ``planner_path``, ``end_panos``): how much nearer the agent came to the end region."""
    s = base_scores(preds, gt, dist)
    m = matched(preds, gt).withColumn("planner_goal", F.element_at("planner_path", -1)).withColumn("first", F.col("pred_path")[0]).withColumn("last", F.element_at("pred_path", -1))
    plan = walked(m.select("instr_id", "scan", "pred_path", "planner_goal"), dist, "pred_path", "planner_goal").select("instr_id", F.col("oracle_error").alias("oracle_plan_error"))
    ends = nearest_of_set(m, dist, {"end_before": "first", "end_after": "last"}, "end_panos")
    s = s.join(plan, "instr_id").join(ends.where("end_before IS NOT NULL AND end_after IS NOT NULL"), "instr_id")
    s = s.withColumn("dist_to_end_reduction", F.col("end_before") - F.col("end_after")).withColumn("shortest_path_length", F.col("start_to_goal"))
    s = s.withColumn("success", (F.col("nav_error") < MARGIN).cast("double"))
    return s.withColumn("spl", _spl(F.col("success")))


def retargeted(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """Rows (instr_id, scan, path, end_panos) whose path ends outside ``end_panos`` get the path of fewest hops to one of them.

    ``paths``: (scan, src, dst, path). Of equally many hops the first end panorama listed wins. Ground
    truth must be taken from the result.
    """
    off = rows.where(~F.array_contains("end_panos", F.element_at("path", -1)))
    each = off.select("instr_id", "scan", F.col("path")[0].alias("src"), F.posexplode("end_panos").alias("pos", "dst"))
    ways = each.join(paths.select("scan", "src", "dst", F.col("path").alias("way")), ["scan", "src", "dst"])
    best = ways.groupBy("instr_id").agg(F.min_by("way", F.struct(F.size("way"), "pos")).alias("_way"))
    return rows.join(best, "instr_id", "left").withColumn("path", F.coalesce("_way", "path")).drop("_way")


# The names under which summaries report.
RATES = {"success": "sr", "oracle_success": "oracle_sr", "spl": "spl", "rgs": "rgs", "rgspl": "rgspl", "det_success": "det_sr", "det_spl": "det_spl"}
MEANS = {"action_steps": "action_steps", "trajectory_steps": "steps", "trajectory_lengths": "lengths", "nav_error": "nav_error", "oracle_error": "oracle_error"}


def summary(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Means of what is measured and, times 100, of the rates, over all scores or by ``keys``."""
    have = set(scores.columns)
    aggs = [F.avg(c).alias(n) for c, n in MEANS.items() if c in have] + [(F.avg(c) * 100).alias(n) for c, n in RATES.items() if c in have]
    return scores.groupBy(*(keys or [])).agg(*aggs)


def dialog_summary(scores: DataFrame) -> DataFrame:
    """Rates within MARGIN as counts over all, and mean reductions."""

    def within(c: str) -> Column:
        return F.avg((F.col(c) < MARGIN).cast("double")) * 100

    return scores.agg(
        F.avg("trajectory_lengths").alias("lengths"), F.avg("nav_error").alias("nav_error"), within("oracle_error").alias("oracle_sr"), within("nav_error").alias("sr"),
        (F.avg("spl") * 100).alias("spl"), within("oracle_plan_error").alias("oracle_path_sr"), F.avg("dist_to_end_reduction").alias("dist_to_end_reduction"),
    )
