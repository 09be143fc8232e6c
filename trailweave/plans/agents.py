"""Geometry, candidate, policy and prompt queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.functions import arrays, geometry as G
from trailweave.operators import candidates as C
from trailweave.operators import prompts as P
from trailweave.plans.base_sql import DIST, EDGES, STEPS
from trailweave.sources import views
from trailweave.sources.tables import table


def _six(*pairs: tuple[str, Column]) -> list[Column]:
    return [F.round(c, 6).alias(n) for n, c in pairs]


def mth_angles(spark: SparkSession, sf: str) -> DataFrame:
    """Angles of events' values: normalised, as fractions, and their features."""
    v = (F.col("value") - 50) / 7
    e = table(spark, sf, "events").select("event_id", v.alias("v"))
    f = G.angle_feature(F.col("v"), F.col("v") / 2, 8)
    return e.select("event_id", *_six(("norm", G.normalised_angle(F.col("v"))), ("heading", G.heading_fraction(F.col("v"))), ("elevation", G.elevation_fraction(F.col("v"))), ("sin_h", f[0]), ("cos_e", f[7])), F.size(f).alias("size"))


def mth06_relative(spark: SparkSession, sf: str) -> DataFrame:
    """Heading, elevation and distance along every edge, from a viewer who looks a little aside."""
    n = views.nodes(spark, sf)
    a = n.select("scan", F.col("vp").alias("src"), *(F.col(c).alias(f"{c}a") for c in "xyz"))
    b = n.select("scan", F.col("vp").alias("dst"), *(F.col(c).alias(f"{c}b") for c in "xyz"))
    e = views.edges(spark, sf).join(a, ["scan", "src"]).join(b, ["scan", "dst"])
    p, q = (tuple(F.col(f"{c}{s}") for c in "xyz") for s in "ab")
    h, el, d = G.relative_position(p, q, F.lit(0.25), F.lit(-0.5))
    return e.select("scan", "src", "dst", *_six(("heading", h), ("elevation", el), ("distance", d)))


def mth07_views(spark: SparkSession, sf: str) -> DataFrame:
    """Heading and elevation of all 36 views, and the 36 x 36 table of relative angles."""
    v = spark.range(36).select(F.col("id").cast("int").alias("base"))
    s = C.sweep(v)
    f = G.angle_feature(F.col("view_heading") - G.view_heading(F.col("base")), F.col("view_elevation") - G.view_elevation(F.col("base")))
    return s.select("base", "view", *((F.round(f[k], 6) + 0.0).alias(f"f{k}") for k in range(4)))


def mth10_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Box features of parts' sizes taken as boxes."""
    p = table(spark, sf, "part").select("p_partkey", F.array(F.lit(5.0), F.lit(7.0), F.col("p_size").cast("double"), F.col("p_retailprice") / 10.3).alias("b"))
    x, y = G.box_feature_xywh(F.col("b")), G.box_feature_xyxy(F.col("b"))
    return p.select("p_partkey", *(F.round(c, 9).alias(n) for n, c in (("h1", x[0]), ("w1", x[1]), ("a1", x[2]), ("h2", y[0]), ("w2", y[1]), ("a2", y[2]))))


def mth13_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Seven-number position features of every connected pair, and of the stop row."""
    n = views.nodes(spark, sf)
    a = n.select("scan", F.col("vp").alias("src"), *(F.col(c).alias(f"{c}a") for c in "xyz"))
    b = n.select("scan", F.col("vp").alias("dst"), *(F.col(c).alias(f"{c}b") for c in "xyz"))
    d = views.dist(spark, sf).join(a, ["scan", "src"]).join(b, ["scan", "dst"])
    p, q = (tuple(F.col(f"{c}{s}") for c in "xyz") for s in "ab")
    f = G.position_feature(G.relative_position(p, q, F.lit(0.0), F.lit(0.0)), F.col("d"), F.col("dst") % 5, F.col("src") % 3 != 0)
    return d.select("scan", "src", "dst", *_six(*((f"f{k}", f[k]) for k in range(7))))


def top06_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The view of every neighbour."""
    best = C.best_views(views.nodes(spark, sf), views.edges(spark, sf))
    return best.select("scan", "vp", "nbr", "view", *_six(("distance", F.col("distance"))))


def jon11_unused_views(spark: SparkSession, sf: str) -> DataFrame:
    """View lists: candidates first, then the views that none uses."""
    n, e = views.nodes(spark, sf), views.edges(spark, sf)
    t = C.view_table(C.best_views(n, e), n)
    used = F.filter("views", lambda v: v["type"] == 1)
    return t.select("scan", "vp", F.size(used).alias("n_candidates"), (F.size("views") - F.size(used)).alias("n_free"), F.array_join(F.transform("views", lambda v: v["view"].cast("string")), ",").alias("views"))


def jon04_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with the parts they carry, at most five by number, none as an empty list."""
    o = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    s = table(spark, sf, "supplier").select("s_suppkey").join(o, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    parts = F.slice(F.coalesce("parts", F.array().cast("array<long>")), 1, 5)
    return s.select("s_suppkey", F.size(parts).alias("n"), F.array_join(F.transform(parts, lambda p: p.cast("string")), ",").alias("parts"))


def agg04_object_viewpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with the suppliers that carry them, in order and with repeats."""
    g = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_list("l_suppkey")).alias("s"))
    return g.select("l_partkey", F.size("s").alias("n"), F.md5(F.array_join(F.transform("s", lambda x: x.cast("string")), ",")).alias("suppliers_md5"))


def st08_expert(spark: SparkSession, sf: str) -> DataFrame:
    """An expert's action from every viewpoint towards its scan's first one."""
    e, d = views.edges(spark, sf), views.dist(spark, sf)
    goal = views.picks(spark, sf, views.reach_of(d)).where("k = 0").select("scan", F.col("vp").alias("goal"))
    o = e.groupBy("scan", F.col("src").alias("cur")).agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))
    rows = o.join(goal, "scan").select("scan", "cur", "goal", (F.col("cur") % 11 == 0).alias("ended"), F.posexplode(F.concat(F.array(F.col("cur")), "nbrs")).alias("option", "vp"))
    return C.expert_action(rows.withColumn("visited", F.col("vp") % 4 == 0), d, ["scan", "cur"])


def st09_object_target(spark: SparkSession, sf: str) -> DataFrame:
    """Where a wanted part is among a supplier's, if the agent arrived."""
    o = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    return o.select("l_suppkey", C.object_target("parts", F.col("l_suppkey") * 7, F.col("l_suppkey") % 2 == 0).cast("long").alias("target"))


def mth14_softmax(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities, entropy and the best index of each embedding's numbers; and the best object."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("s"))
    p = arrays.softmax(F.col("s"))
    ids = F.transform(F.sequence(F.lit(0), F.size("s") - 2), lambda k: F.concat(F.lit("o"), k.cast("string")))
    made = e.select("vec_id", *_six(("p0", p[0]), ("entropy", arrays.entropy(p))), arrays.argmax(F.col("s")).alias("best"), ids.alias("ids"), "s")
    return made.select("vec_id", "p0", "entropy", "best", C.chosen_object("s", "ids").alias("object"))


def agg09_mean_vector(spark: SparkSession, sf: str) -> DataFrame:
    """Mean embedding of every label, a row per number: averaged on the map side first."""
    e = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    return e.groupBy("label", "k").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def prm_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """All prompts, for users' turns with varying history and candidates."""
    t = table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("i"), (F.col("turn") % 4).cast("int").alias("h"), (F.col("conv_id") % 5).cast("int").alias("c"))
    i, h, c = F.col("i"), F.col("h"), F.col("c")
    made = {f"nav_{k}": P.navigation(k, i, h, c) for k in P.NAVIGATION} | {f"sum_{k}": P.summarisation(k, h, c) for k in P.SUMMARISATION}
    made |= {f"obj_{k}": P.grounding(k, i, h, c) for k in ("soon", "reverie")} | {f"qa_{k}": P.question(k, i, h, c) for k in P.QUESTION}
    made |= {"scene": P.scene_question(i, c), "image": P.image_question(i)}
    return t.select("conv_id", "turn", *(F.md5(v).alias(k) for k, v in made.items()))


def prm07_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """The navigation prompt of each document's task, by its number."""
    names = list(P.NAVIGATION)
    task = F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", task.alias("task"), F.coalesce("text", F.lit("")).alias("i"))
    return d.select("doc_id", "task", F.md5(P.by_task(F.col("task"), {k: P.navigation(k, F.col("i"), F.lit(2), F.lit(3)) for k in names})).alias("prompt_md5"))


def obs05_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Graph memories of a week's trajectories: stop, visited and unvisited nodes with masks and steps."""
    s = views.steps(spark, sf).groupBy("instr_id", F.col("node").alias("vp")).agg(F.min("pos").alias("arrival"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"))
    m = s.select("instr_id", "vp", "arrival", (F.col("vp") % 3 != 0).alias("visited"), (F.col("last") + 1).cast("int").alias("step"))
    g = C.graph_nodes(m, ["instr_id"])
    text = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")
    return g.select("instr_id", text("vps").alias("vps"), text("visited_mask").alias("mask"), text("steps").alias("steps"), "no_vp_left")


QUERIES = {
    f.__name__: f
    for f in (
        mth_angles, mth06_relative, mth07_views, mth10_boxes, mth13_positions, top06_candidates, jon11_unused_views, jon04_objects, agg04_object_viewpoints, st08_expert,
        st09_object_target, mth14_softmax, agg09_mean_vector, prm_prompts, prm07_dispatch, obs05_graph,
    )
}

_STEP, _FULL = repr(G.STEP), repr(G.FULL)
_MOD = lambda x, m: f"(({x}) - floor(({x}) / {m}) * {m})"
_NORM = lambda x: f"(CASE WHEN {_MOD(x, _FULL)} > pi() THEN {_MOD(x, _FULL)} - {_FULL} ELSE {_MOD(x, _FULL)} END)"
_ENDS = "a ON a.scan = e.scan AND a.vp = e.src JOIN nodes b ON b.scan = e.scan AND b.vp = e.dst"
_SIDE = "asin((b.x-a.x) / greatest(sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y)), 1e-8))"
_HEAD = f"(CASE WHEN b.y < a.y THEN pi() - {_SIDE} ELSE {_SIDE} END)"
_FAR = "greatest(sqrt((b.x-a.x)*(b.x-a.x) + (b.y-a.y)*(b.y-a.y) + (b.z-a.z)*(b.z-a.z)), 1e-8)"
_ELEV = f"asin((b.z-a.z) / {_FAR})"
VIEWS_OF = f"""along AS (SELECT e.scan, e.src AS vp, e.dst AS nbr, {_HEAD} AS h, {_ELEV} AS el FROM edges e JOIN nodes {_ENDS}),
seen AS (SELECT scan, vp, nbr, view, sqrt(power({_NORM(f"h - (view % 12) * {_STEP}")}, 2) + power(el - (view // 12 - 1) * {_STEP}, 2)) AS off FROM along, (SELECT unnest(range(36)) AS view)),
best AS (SELECT scan, vp, nbr, CAST(view AS INTEGER) AS view, off FROM (SELECT *, row_number() OVER (PARTITION BY scan, vp, nbr ORDER BY round(off, 9), view) AS o FROM seen) WHERE o = 1)"""
_SEEN = f"{EDGES},\n{VIEWS_OF}"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _numbered_sql(n: str, mark: str, first: str | None = None) -> str:
    return f"array_to_string(list_transform(range({n}), lambda k: '(' || k || ') ' || CASE WHEN k = 0 THEN '{first or mark}' ELSE '{mark}' END), ' ')"


def _filled_sql(template: str, value: str) -> str:
    a, b = template.split("{}")
    return f"{_literal(a)} || {value} || {_literal(b)}"


def _prompts_sql() -> dict[str, str]:
    nl = "chr(10)"
    hist = lambda h: f"{_literal(P.HISTORY)} || '### History: ' || {_numbered_sql(h, '<hist>')} || {nl}"
    seen = f"(CASE WHEN c <> 0 THEN {_literal(P.OBSERVATION)} || '### Candidate: ' || {_numbered_sql('c', '<cand>')} || {nl} ELSE '' END)"
    nav = lambda k, i, h, c: (
        f"{_filled_sql(P.NAVIGATION[k][0], f'replace({i}, chr(63), {chr(39) * 2})' if k == 'eqa' else i)} || {hist(h)} || {_literal(P.CANDIDATE)}"
        f" || '### Candidate: ' || {_numbered_sql(c, '<cand>', 'stop')} || {nl} || {_literal(P.NAVIGATION[k][1])} || '### Output: <cls>'"
    )
    out = {f"nav_{k}": nav(k, "i", "h", "c") for k in P.NAVIGATION}
    out |= {f"sum_{k}": f"{_literal(a)} || {hist('h')} || {seen} || {_literal(b)} || '### Answer: '" for k, (a, b) in P.SUMMARISATION.items()}
    for k in ("soon", "reverie"):
        out[f"obj_{k}"] = (
            f"{_literal(P.GROUNDING_HEAD)} || {_filled_sql(P.NAVIGATION[k][0], 'i')} || {hist('h')} || {_literal(P.OBJECT)} || '### Object: ' || {_numbered_sql('c', '<cand>', 'not exist')}"
            f" || {nl} || {_literal(P.GROUNDING_HINT)} || '### Output: <cls>'"
        )
    for k, a in P.QUESTION.items():
        told = f"(CASE WHEN h <> 0 THEN {hist('h')} ELSE '' END)" if k == "r2r" else hist("h")
        out[f"qa_{k}"] = f"{_literal(a)} || {told} || {seen} || '### Question: ' || i || {nl} || '### Answer: '"
    out["scene"] = f"{_literal(P.SCENE_QUESTION[0])} || '### Observation: ' || {_numbered_sql('c', '<cand>')} || ' ' || {nl} || '### Question: ' || i || {nl} || '### Answer: '"
    out["image"] = f"{_literal(P.IMAGE_QUESTION[0])} || '### Instruction: ' || i || {nl} || '### Output: '"
    out["_nav_fixed"] = "CASE task " + " ".join(f"WHEN '{k}' THEN {nav(k, 'i', '2', '3')}" for k in P.NAVIGATION) + " END"
    return out


_PROMPTS = _prompts_sql()
_V = "((value - 50) / 7)"

ORACLE = {
    "mth_angles": f"""SELECT event_id, round({_NORM(_V)}, 6) AS norm, round({_MOD(_V, _FULL)} / {_FULL}, 6) AS heading, round(({_NORM(_V)} + pi()) / {_FULL}, 6) AS elevation,
       round(sin({_V}), 6) AS sin_h, round(cos({_V} / 2), 6) AS cos_e, 8 AS size FROM events""",
    "mth06_relative": f"""WITH {EDGES} SELECT e.scan, e.src, e.dst, round({_HEAD} - 0.25, 6) AS heading, round({_ELEV} + 0.5, 6) AS elevation, round({_FAR}, 6) AS distance FROM edges e JOIN nodes {_ENDS}""",
    "mth07_views": f"""SELECT CAST(base AS INTEGER) AS base, CAST(view AS INTEGER) AS view, round(sin((view % 12 - base % 12) * {_STEP}), 6) + 0.0 AS f0, round(cos((view % 12 - base % 12) * {_STEP}), 6) + 0.0 AS f1,
       round(sin((view // 12 - base // 12) * {_STEP}), 6) + 0.0 AS f2, round(cos((view // 12 - base // 12) * {_STEP}), 6) + 0.0 AS f3 FROM (SELECT unnest(range(36)) AS base), (SELECT unnest(range(36)) AS view)""",
    "mth10_boxes": """WITH b AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, p_retailprice / 10.3 AS h FROM part)
SELECT p_partkey, round(h / 480, 9) AS h1, round(w / 640, 9) AS w1, round(h / 480 * (w / 640), 9) AS a1, round((h - 7) / 224, 9) AS h2, round((w - 5) / 224, 9) AS w2, round((h - 7) / 224 * ((w - 5) / 224), 9) AS a2 FROM b""",
    "mth13_positions": f"""WITH {DIST},
f AS (SELECT e.scan, e.src, e.dst, e.src % 3 <> 0 AS k, {_HEAD} AS h, {_ELEV} AS el, {_FAR} AS far, e.d FROM dist e JOIN nodes {_ENDS})
SELECT scan, src, dst, round(CASE WHEN k THEN sin(h) ELSE 0.0 END, 6) AS f0, round(CASE WHEN k THEN cos(h) ELSE 1.0 END, 6) AS f1, round(CASE WHEN k THEN sin(el) ELSE 0.0 END, 6) AS f2,
       round(CASE WHEN k THEN cos(el) ELSE 1.0 END, 6) AS f3, round(CASE WHEN k THEN far / 30 ELSE 0.0 END, 6) AS f4, round(CASE WHEN k THEN d / 30 ELSE 0.0 END, 6) AS f5, round(CASE WHEN k THEN (dst % 5) / 10.0 ELSE 0.0 END, 6) AS f6 FROM f""",
    "top06_candidates": f"WITH {_SEEN} SELECT scan, vp, nbr, view, round(off, 6) AS distance FROM best",
    "jon11_unused_views": f"""WITH {_SEEN},
c AS (SELECT n.scan, n.vp, list(b.view ORDER BY b.nbr) FILTER (b.view IS NOT NULL) AS used FROM nodes n LEFT JOIN best b USING (scan, vp) GROUP BY 1, 2),
l AS (SELECT scan, vp, coalesce(used, []) AS used, list_filter(range(36), lambda v: NOT list_contains(coalesce(used, []), v)) AS free FROM c)
SELECT scan, vp, len(used) AS n_candidates, len(free) AS n_free, array_to_string(list_concat(used, free), ',') AS views FROM l""",
    "jon04_objects": """WITH o AS (SELECT l_suppkey, list(DISTINCT l_partkey ORDER BY l_partkey) AS p FROM lineitem GROUP BY 1),
s AS (SELECT s_suppkey, coalesce(p, [])[1:5] AS p FROM supplier LEFT JOIN o ON s_suppkey = l_suppkey)
SELECT s_suppkey, len(p) AS n, array_to_string(p, ',') AS parts FROM s""",
    "agg04_object_viewpoints": "SELECT l_partkey, count(*) AS n, md5(string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey)) AS suppliers_md5 FROM lineitem GROUP BY 1",
    "st08_expert": f"""WITH {DIST},
reach AS (SELECT scan, src AS vp, count(*) AS reach FROM dist GROUP BY 1, 2),
goals AS (SELECT r.scan, min(r.vp) AS goal FROM reach r JOIN (SELECT scan, max(reach) AS m FROM reach GROUP BY 1) x ON x.scan = r.scan AND x.m = r.reach GROUP BY 1),
o AS (SELECT e.scan, e.src AS cur, e.dst AS vp, g.goal, row_number() OVER (PARTITION BY e.scan, e.src ORDER BY e.dst) AS option FROM edges e JOIN goals g USING (scan)),
cost AS (SELECT o.*, CASE WHEN o.vp % 4 <> 0 THEN a.d + b.d END AS c FROM o LEFT JOIN dist a ON a.scan = o.scan AND a.src = o.vp AND a.dst = o.goal LEFT JOIN dist b ON b.scan = o.scan AND b.src = o.cur AND b.dst = o.vp),
best AS (SELECT scan, cur, goal, option FROM (SELECT *, row_number() OVER (PARTITION BY scan, cur ORDER BY c, option) AS k FROM cost WHERE c IS NOT NULL) WHERE k = 1)
SELECT x.scan, x.cur, CAST(CASE WHEN x.cur % 11 = 0 THEN -100 WHEN x.cur = x.goal THEN 0 ELSE coalesce(b.option, -100) END AS INTEGER) AS action
FROM (SELECT DISTINCT scan, cur, goal FROM o) x LEFT JOIN best b USING (scan, cur)""",
    "st09_object_target": """WITH o AS (SELECT l_suppkey, list(DISTINCT l_partkey ORDER BY l_partkey) AS p FROM lineitem GROUP BY 1)
SELECT l_suppkey, CAST(CASE WHEN l_suppkey % 2 = 0 AND list_contains(p, l_suppkey * 7) THEN list_position(p, l_suppkey * 7) ELSE -100 END AS BIGINT) AS target FROM o""",
    "mth14_softmax": """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS s FROM embeddings),
x AS (SELECT vec_id, s, list_transform(s, lambda v: exp(v - list_max(s))) AS e FROM s), p AS (SELECT vec_id, s, list_transform(e, lambda v: v / list_sum(e)) AS p FROM x)
SELECT vec_id, round(p[1], 6) AS p0, round(-list_sum(list_transform(p, lambda q: q * ln(q))), 6) AS entropy, list_position(s, list_max(s)) - 1 AS best,
       'o' || (list_position(s[2:], list_max(s[2:])) - 1) AS object FROM p""",
    "agg09_mean_vector": """WITH e AS (SELECT label, unnest(range(len(embedding))) AS k, unnest(embedding) AS x FROM embeddings)
SELECT label, CAST(k AS INTEGER) AS k, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM e GROUP BY 1, 2""",
    "prm_prompts": "WITH t AS (SELECT conv_id, turn, text AS i, turn % 4 AS h, conv_id % 5 AS c FROM conversations WHERE role = 'user') SELECT conv_id, turn, "
    + ", ".join(f"md5({v}) AS {k}" for k, v in _PROMPTS.items() if k[0] != "_") + " FROM t",
    "prm07_dispatch": f"""WITH d AS (SELECT doc_id, [{", ".join(repr(k) for k in P.NAVIGATION)}][doc_id % {len(P.NAVIGATION)} + 1] AS task, coalesce(text, '') AS i FROM documents)
SELECT doc_id, task, md5({_PROMPTS["_nav_fixed"]}) AS prompt_md5 FROM d""",
}


def _obs05() -> str:
    return f"""WITH {STEPS},
m AS (SELECT instr_id, node AS vp, min(pos) AS arrival, max(pos) + 1 AS step, node % 3 <> 0 AS visited FROM steps GROUP BY 1, 2)
SELECT instr_id, '-,' || string_agg(CAST(vp AS VARCHAR), ',' ORDER BY NOT visited, arrival, vp) AS vps,
       '0,' || string_agg(CASE WHEN visited THEN '1' ELSE '0' END, ',' ORDER BY NOT visited, arrival, vp) AS mask,
       '0,' || string_agg(CAST(step AS VARCHAR), ',' ORDER BY NOT visited, arrival, vp) AS steps, bool_and(visited) AS no_vp_left FROM m GROUP BY 1"""


ORACLE["obs05_graph"] = _obs05()
