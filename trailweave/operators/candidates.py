"""Where an agent can go next, and what it sees there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.functions import geometry as G


def sweep(viewpoints: DataFrame) -> DataFrame:
    """Each row with every view: ``view``, ``view_heading``, ``view_elevation``."""
    v = viewpoints.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(G.VIEWS - 1))))
    return v.withColumn("view_heading", G.view_heading(F.col("view"))).withColumn("view_elevation", G.view_elevation(F.col("view")))


def best_views(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scan, vp, nbr, view, heading, elevation, distance): every neighbour with the view whose middle it is nearest, and its angle off it.

    Of equally near views the first. Decided in the edge's own row, by arithmetic.
    """
    at = nodes.select("scan", F.col("vp").alias("src"), *(F.col(c).alias(f"{c}a") for c in "xyz"))
    to = nodes.select("scan", F.col("vp").alias("dst"), *(F.col(c).alias(f"{c}b") for c in "xyz"))
    e = edges.select("scan", "src", "dst").join(at, ["scan", "src"]).join(to, ["scan", "dst"])
    a, b = (tuple(F.col(f"{c}{s}") for c in "xyz") for s in "ab")
    heading, elevation, _ = G.relative_position(a, b, F.lit(0.0), F.lit(0.0))
    rows = e.select("scan", F.col("src").alias("vp"), F.col("dst").alias("nbr"), heading.alias("heading"), elevation.alias("elevation"))

    # rings and headings are even steps apart, so the nearest view is one of the two rings and two headings around
    ring = F.least(F.greatest(F.floor((F.col("elevation") + G.STEP) / G.STEP), F.lit(0)), F.lit(G.VIEWS // G.RING - 2))
    turn = F.floor(F.pmod(F.col("heading"), F.lit(G.FULL)) / G.STEP)
    near = rows.withColumn("ring", ring.cast("int")).withColumn("turn", turn.cast("int"))
    near = near.select("*", *(G.normalised_angle(F.col("heading") - (F.col("turn") + k) * G.STEP).alias(f"h{k}") for k in (0, 1)), *(((F.col("elevation") - (F.col("ring") + k - 1) * G.STEP)).alias(f"e{k}") for k in (0, 1)))
    near = near.select("*", *(F.hypot(f"h{k % 2}", f"e{k // 2}").alias(f"o{k}") for k in range(4)), *(((F.col("ring") + k // 2) * G.RING + (F.col("turn") + k % 2) % G.RING).alias(f"v{k}") for k in range(4)))
    options = [F.struct(F.round(f"o{k}", 9).alias("r"), F.col(f"v{k}").alias("view"), F.col(f"o{k}").alias("distance")) for k in range(4)]
    best = near.withColumn("b", F.least(*options))
    return best.select("scan", "vp", "nbr", "b.view", "heading", "elevation", "b.distance")


def view_table(candidates: DataFrame, viewpoints: DataFrame) -> DataFrame:
    """(scan, vp, views array<struct<type, view, nbr>>): candidates' views first (type 1), then views no candidate uses (type 0)."""
    used = candidates.select("scan", "vp", "view").distinct()
    free = sweep(viewpoints.select("scan", "vp")).select("scan", "vp", "view").join(used, ["scan", "vp", "view"], "left_anti")
    rows = candidates.select("scan", "vp", F.lit(0).alias("o"), "view", "nbr", F.lit(1).alias("type")).unionByName(
        free.select("scan", "vp", F.lit(1).alias("o"), "view", F.lit(None).cast(candidates.schema["nbr"].dataType).alias("nbr"), F.lit(0).alias("type"))
    )
    lists = rows.groupBy("scan", "vp").agg(F.array_sort(F.collect_list(F.struct("o", "nbr", "view", "type"))).alias("l"))
    return lists.select("scan", "vp", F.transform("l", lambda r: F.struct(r["type"].alias("type"), r["view"].alias("view"), r["nbr"].alias("nbr"))).alias("views"))


def expert_action(rows: DataFrame, dist: DataFrame, keys: list[str]) -> DataFrame:
    """The action an expert takes among numbered options.

    rows: keys, scan, cur, goal, ended, option (0: stop), vp, visited. Ended rows get -100; at the goal
    the expert stops; else it takes the unvisited option of least way there and on, the first of equals;
    -100 if none is left.
    """
    on = dist.select("scan", F.col("src").alias("vp"), F.col("dst").alias("goal"), F.col("d").alias("on"))
    there = dist.select("scan", F.col("src").alias("cur"), F.col("dst").alias("vp"), F.col("d").alias("there"))
    r = rows.join(on, ["scan", "vp", "goal"], "left").join(there, ["scan", "cur", "vp"], "left")
    cost = F.when((F.col("option") > 0) & ~F.col("visited"), F.col("on") + F.col("there"))
    best = F.min_by("option", F.when(cost.isNotNull(), F.struct(cost, F.col("option"))))
    found = r.groupBy(*keys).agg(F.bool_or("ended").alias("e"), F.bool_or(F.col("cur") == F.col("goal")).alias("g"), best.alias("b"))
    return found.select(*keys, F.when(F.col("e"), -100).when(F.col("g"), 0).otherwise(F.coalesce("b", F.lit(-100))).alias("action"))


def expert_step(path: Column, step: Column, options: Column) -> Column:
    """The action of an expert who follows an annotated path: the place among ``options`` (0: stop) of the path's next viewpoint.

    0 at the path's end; null if the next viewpoint is not among them.
    """
    following = F.get(path, step + 1)
    at = F.array_position(options, following)
    return F.when(step >= F.size(path) - 1, F.lit(0).cast("long")).when(at > 0, at - 1)


def valid_options(own: Column, visited: Column) -> Column:
    """Whether each option can be chosen: in the length mask and not visited."""
    return F.zip_with(own, visited, lambda m, v: m & ~v)


#: The score of what must not be chosen: a sixteenth of the least single-precision number (a fixed value).
LEAST_SCORE = -3.4028234663852886e38 / 16


def forced_stop(scores: Column, valid: Column, ended: Column) -> Column:
    """Scores of a row that goes on though nothing is valid: stopping (the first) alone is left; others stay as they are."""
    none = ~F.coalesce(F.exists(valid, lambda v: v), F.lit(False))
    only_stop = F.transform(scores, lambda s, k: F.when(k == 0, F.lit(0.0)).otherwise(F.lit(LEAST_SCORE)))
    return F.when(~ended & none, only_stop).otherwise(scores)


def mask_size(mask: Column) -> Column:
    """How many places a mask has, 1 for none: a divisor of means that is never 0."""
    return F.greatest(F.size(F.filter(mask, lambda m: m)), F.lit(1))


def object_target(objects: str, wanted: Column, arrived: Column) -> Column:
    """Number from 1 of the wanted object among those in sight, -100 if it isn't or the agent is elsewhere. Ids compare as text."""
    at = F.array_position(F.transform(objects, lambda o: o.cast("string")), wanted.cast("string"))
    return F.when(arrived & (at > 0), at).otherwise(-100)


def chosen_object(scores: str, ids: str) -> Column:
    """The id of the best-scored object; score 0 is for none and does not count. Null without objects."""
    rest = F.slice(scores, 2, F.greatest(F.size(scores) - 1, F.lit(0)))
    return F.when(F.size(rest) > 0, F.try_element_at(ids, F.array_position(rest, F.array_max(rest)).cast("int")))


def graph_nodes(memory: DataFrame, keys: list[str], full: bool = True) -> DataFrame:
    """(keys, vps, visited_mask, steps, no_vp_left) of graph memories (keys, vp, visited, step, arrival).

    The list begins with null for stopping, then come visited and unvisited nodes by arrival, or the
    unvisited ones alone.
    """
    r = memory if full else memory.where(~F.col("visited"))
    o = F.array_sort(F.collect_list(F.struct((~F.col("visited")).cast("int").alias("u"), "arrival", "vp", F.coalesce("step", F.lit(0)).alias("step"))))
    left = memory.groupBy(*keys).agg(F.bool_and("visited").alias("no_vp_left"))
    lists = left.join(r.groupBy(*keys).agg(o.alias("l")), keys, "left").withColumn("l", F.coalesce("l", F.array().cast(f"array<struct<u:int,arrival:{dict(memory.dtypes)['arrival']},vp:{dict(memory.dtypes)['vp']},step:int>>")))
    none = F.lit(None).cast(memory.schema["vp"].dataType)
    mask = F.transform("l", lambda x: (1 - x["u"]) if full else F.lit(0))
    return lists.select(*keys, F.concat(F.array(none), F.col("l.vp")).alias("vps"), F.concat(F.array(F.lit(0)), mask).alias("visited_mask"), F.concat(F.array(F.lit(0)), F.col("l.step")).alias("steps"), "no_vp_left")


def local_positions(options: DataFrame, start: str, own: str) -> DataFrame:
    """Fourteen-number positions of options: the start's seven, then the option's own; the stop row's own are zeros.

    options: rows with ``start`` and ``own`` (arrays of seven; ``own`` null for stopping).
    """
    none = F.array_repeat(F.lit(0.0), 7)
    return options.withColumn("position", F.concat(start, F.coalesce(own, none))).drop(start, own)
