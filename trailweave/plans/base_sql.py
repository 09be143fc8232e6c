"""The derived views as DuckDB CTEs, for the queries' oracle SQL."""

from __future__ import annotations

from trailweave.functions.arrays import SPACES
from trailweave.sources.views import IDS_OF_A_SCAN, LABELS, RADIUS, WEEK


def words_sql(column: str = "text") -> str:
    """The words of a text, between Unicode white space."""
    return f"list_filter(regexp_split_to_array({column}, '{SPACES}+'), lambda x: x <> '')"


def stripped_sql(column: str) -> str:
    """A text without Unicode white space at either end."""
    return rf"regexp_replace({column}, '\A{SPACES}+|{SPACES}+\z', '', 'g')"


def _squared(n: int, of: str) -> str:
    return f"{n} AS MATERIALIZED (SELECT a.scan, a.src, b.dst, min(a.d + b.d) AS d FROM {of} a JOIN {of} b ON a.scan = b.scan AND a.dst = b.src GROUP BY 1, 2, 3)"


NODES = f"""nodes AS (
  SELECT CAST(label + {LABELS} * (vec_id // {IDS_OF_A_SCAN}) AS INTEGER) AS scan, vec_id AS vp, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z
  FROM embeddings)"""
EDGES = f"""{NODES},
edges AS MATERIALIZED (
  SELECT a.scan, a.vp AS src, b.vp AS dst, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS w
  FROM nodes a JOIN nodes b ON a.scan = b.scan AND a.vp <> b.vp
  WHERE sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) < {RADIUS})"""
DIST = f"""{EDGES},
d1 AS (SELECT scan, src, dst, w AS d FROM edges UNION ALL SELECT scan, vp, vp, 0.0 FROM nodes),
{_squared("d2", "d1")}, {_squared("d4", "d2")}, {_squared("d8", "d4")}, {_squared("dist", "d8")}"""
PICKS = f"""{DIST},
reach AS (SELECT scan, src AS vp, count(*) AS reach FROM dist GROUP BY 1, 2),
able AS (SELECT r.scan, r.vp FROM reach r JOIN (SELECT scan, max(reach) AS most FROM reach GROUP BY 1) m ON r.scan = m.scan AND r.reach = m.most),
picks AS (SELECT scan, vp, row_number() OVER (PARTITION BY scan ORDER BY vp) - 1 AS k, count(*) OVER (PARTITION BY scan) AS n FROM able)"""
STEPS = f"""{PICKS},
moves AS (
  SELECT event_id, user_id, CAST(floor(epoch(ts) / {WEEK}) AS BIGINT) AS week, CAST(user_id % (SELECT max(scan) + 1 FROM nodes) AS INTEGER) AS scan,
         row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts) / {WEEK}) AS BIGINT) ORDER BY ts, event_id) - 1 AS pos
  FROM events),
steps AS MATERIALIZED (
  SELECT 'r2r_' || m.user_id || '_' || m.week AS instr_id, m.user_id, m.week, m.scan, m.pos, p.vp AS node, g.vp AS goal
  FROM moves m
  JOIN (SELECT DISTINCT scan, n FROM picks) s ON s.scan = m.scan
  JOIN picks p ON p.scan = m.scan AND p.k = (m.event_id * 7919 + m.pos) % s.n
  JOIN picks g ON g.scan = m.scan AND g.k = (m.user_id * 31 + m.week * 17) % s.n)"""
WALKED = f"""{STEPS},
pairs AS (SELECT *, lag(node) OVER (PARTITION BY instr_id ORDER BY pos) AS prev FROM steps),
walked AS MATERIALIZED (
  SELECT p.instr_id, any_value(p.user_id) AS user_id, any_value(p.week) AS week, any_value(p.scan) AS scan, any_value(p.goal) AS goal,
         arg_min(p.node, p.pos) AS first_node, arg_max(p.node, p.pos) AS last_node, list(p.node ORDER BY p.pos) AS path,
         count(*) AS n, arg_max(g.d, p.pos) AS nav_error, min(g.d) AS oracle_error, arg_min(g.d, p.pos) AS gt_lengths,
         coalesce(sum(m.d), 0) AS trajectory_lengths
  FROM pairs p JOIN dist g ON g.scan = p.scan AND g.src = p.node AND g.dst = p.goal
  LEFT JOIN dist m ON m.scan = p.scan AND m.src = p.prev AND m.dst = p.node
  GROUP BY p.instr_id)"""
