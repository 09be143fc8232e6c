"""Graphs: edges, constraints, distances and paths."""

import heapq
import random

import pytest

from trailweave.operators import graph as G

def dijkstra(edges, source):
    """Plain single-source distances over (src, dst, w) rows."""
    out, near, heap = {}, {}, [(0.0, source)]
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
    while heap:
        d, at = heapq.heappop(heap)
        if at not in out:
            out[at] = d
            for b, w in near.get(at, []):
                heapq.heappush(heap, (d + w, b))
    return out


NODES = "scan string, vp long, x double, y double, z double"
EDGES = "scan string, src long, dst long, w double"


@pytest.fixture(scope="module")
def nodes(spark):
    rnd = random.Random(1)
    return spark.createDataFrame([(s, v, *(rnd.uniform(-1, 1) for _ in "xyz")) for s in "ab" for v in range(40)], NODES).cache()


def near(nodes, r):
    rows = [tuple(n) for n in nodes.collect()]
    gap = lambda p, q: sum((a - b) ** 2 for a, b in zip(p[2:], q[2:])) ** 0.5
    return [(p[0], p[1], q[1], gap(p, q)) for p in rows for q in rows if p[0] == q[0] and p[1] != q[1] and gap(p, q) < r]


@pytest.mark.parametrize("radius", [0.3, 0.7])
def test_radius_edges(nodes, radius):
    got = {(r.scan, r.src, r.dst): r.w for r in G.radius_edges(nodes, radius).collect()}
    assert got == pytest.approx({r[:3]: r[3] for r in near(nodes, radius)})


def test_distances_and_paths(spark, nodes):
    rows = near(nodes, 0.7)
    edges = spark.createDataFrame(rows, EDGES)
    d = {(r.scan, r.src, r.dst): r.d for r in G.shortest_distances(edges, nodes).collect()}
    p = {(r.scan, r.src, r.dst): r for r in G.shortest_paths(edges, nodes).collect()}
    w = {r[:3]: r[3] for r in rows}
    for s in "ab":
        for v in range(40):
            want = dijkstra([r[1:] for r in rows if r[0] == s], v)
            assert {k[2]: x for k, x in d.items() if k[:2] == (s, v)} == pytest.approx(want)
    assert p.keys() == d.keys()
    for (s, a, b), r in p.items():
        assert r.path[0] == a and r.path[-1] == b and r.hops == len(r.path) - 1
        assert sum(w[s, x, y] for x, y in zip(r.path, r.path[1:])) == pytest.approx(d[s, a, b])
    joined = {(r.scan, r.src, r.dst): r.d for r in G.min_plus_distances(edges, nodes).collect()}
    assert joined == pytest.approx(d)


def test_asymmetry_raises(spark):
    ok = spark.createDataFrame([("a", 1, 2, 1.0), ("a", 2, 1, 1.0)], EDGES)
    assert G.checked_symmetric(ok).count() == 2
    with pytest.raises(Exception, match="not symmetric"):
        G.checked_symmetric(spark.createDataFrame([("a", 1, 2, 1.0)], EDGES)).collect()


def test_connectivity(spark):
    rows = [("s", 0, "p", True, [False, True, True], 0.0, 0.0, 0.0), ("s", 1, "q", True, [True, False, False], 3.0, 4.0, 0.0), ("s", 2, "r", False, [True, False, False], 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "scan string, pos int, vp string, included boolean, unobstructed array<boolean>, x double, y double, z double")
    assert sorted(tuple(r) for r in G.connectivity_edges(df).collect()) == [("s", "p", "q", 5.0), ("s", "q", "p", 5.0)]


def test_too_large_a_scan_is_an_error(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(G, "MOST_NODES", 2)
    with pytest.raises(ValueError, match="min_plus"):
        G.weights(pd.DataFrame({"scan": ["a"] * 3, "src": [1, 2, 3], "dst": [2, 3, 1], "w": [1.0] * 3}))


def test_long_chains_by_joins(spark):
    """Forty hops in a row: known only after six squarings."""
    n = spark.createDataFrame([("s", k, float(k), 0.0, 0.0) for k in range(41)], NODES)
    e = spark.createDataFrame([("s", a, b, 1.0) for k in range(40) for a, b in ((k, k + 1), (k + 1, k))], EDGES)
    assert {(r.src, r.dst): r.d for r in G.min_plus_distances(e, n).collect()} == {(a, b): abs(a - b) for a in range(41) for b in range(41)}


def test_scans_of_any_size(spark, nodes):
    edges = spark.createDataFrame([r for r in near(nodes, 0.7) if r[0] == "a" or r[1] < 20 and r[2] < 20], EDGES)
    some = nodes.where("scan = 'a' OR vp < 20")
    want = {(r.scan, r.src, r.dst): r.d for r in G.shortest_distances(edges, some).collect()}
    got = {(r.scan, r.src, r.dst): r.d for r in G.distances(edges, some, most=30).collect()}
    assert got == pytest.approx(want) and {k[0] for k in got} == {"a", "b"}


def test_forms_for_large_scans_are_the_same(spark):
    """Bounds that no scan keeps, so that everything goes by joins; also one that parts the scans."""
    rng = random.Random(12)
    nodes, edges = [], []
    for scan, n in ((1, 14), (2, 5), (3, 1)):
        at = {v: [rng.random() for _ in range(3)] for v in range(scan * 100, scan * 100 + n)}
        nodes += [(scan, v, *p) for v, p in at.items()]
        for a in at:
            for b in at:
                if a < b and rng.random() < 0.25:
                    w = sum((x - y) ** 2 for x, y in zip(at[a], at[b])) ** 0.5
                    edges += [(scan, a, b, w), (scan, b, a, w)]
    nodes = spark.createDataFrame(nodes, "scan int, vp long, x double, y double, z double")
    edges = spark.createDataFrame(edges, "scan int, src long, dst long, w double")
    rows = lambda df: sorted((r.scan, r.src, r.dst, round(r.d, 9), *((r.hops, tuple(r.path)) if "path" in df.columns else ())) for r in df.collect())
    every = rows(G.shortest_paths(edges, nodes))
    for most in (0, 6, 100):
        assert rows(G.paths(edges, nodes, most)) == every
        assert rows(G.distances(edges, nodes, most)) == [r[:4] for r in every]
        reach = {(r.scan, r.vp): r.reach for r in G.reached(edges, nodes, most).collect()}
        assert reach == {(s, v): sum(r[:2] == (s, v) for r in every) for s, v, *_ in every}
    ends = nodes.select("scan", "vp")
    asked = ends.withColumnRenamed("vp", "src").join(ends.withColumnRenamed("vp", "dst"), "scan").where("(src * 7 + dst) % 3 = 0")
    wanted = [r for r in every if (r[1] * 7 + r[2]) % 3 == 0]
    for most in (0, 20, 1000):
        assert rows(G.asked_paths(edges, asked.unionByName(asked), most)) == wanted
        assert rows(G.asked_distances(edges, asked.unionByName(asked), most)) == [r[:4] for r in wanted]
    assert not G.asked_paths(edges, asked.limit(0)).count() and not G.asked_paths(edges.limit(0), asked.where("src <> dst")).count()


def test_asked_paths_in_blocks_of_sources(spark, monkeypatch):
    edges = spark.createDataFrame([(1, a, b, 1.0) for k in range(30) for a, b in ((k, k + 1), (k + 1, k))], "scan int, src long, dst long, w double")
    asked = spark.createDataFrame([(1, a, 29 - a) for a in range(30)] + [(1, 3, 99)], "scan int, src long, dst long")
    monkeypatch.setattr(G, "BLOCK", 1)
    got = {r.src: (r.d, r.path) for r in G.asked_paths(edges, asked).collect()}
    assert len(got) == 30 and got[0] == (29.0, list(range(30))) and got[20] == (11.0, list(range(20, 8, -1)))


def test_distances_by_tiles(spark, nodes):
    """Blocks of a few nodes, so that scans of unlike size need unlike rounds."""
    edges = spark.createDataFrame([r for r in near(nodes, 0.6) if r[0] == "a" or r[1] < 9 and r[2] < 9], EDGES)
    some = nodes.where("scan = 'a' OR vp < 9")
    want = {(r.scan, r.src, r.dst): r.d for r in G.shortest_distances(edges, some).collect()}
    found = [((r.scan, r.src, r.dst), r.d) for r in G.min_plus_distances(edges, some, 15).collect()]
    assert len(found) == len(want) and dict(found) == pytest.approx(want)


@pytest.mark.parametrize("block", [4, 100])
def test_asked_paths_by_tiles(spark, block):
    """Blocks of a few nodes, whole weights so that many ways are equally short, and names that are texts."""
    rng = random.Random(block)
    links = [(s, f"n{a:02}", f"n{b:02}", float(rng.randint(1, 3))) for s, n in ((1, 20), (2, 5)) for a in range(n) for b in range(n) if a != b and rng.random() < 0.15]
    edges = spark.createDataFrame(links, "scan int, src string, dst string, w double")
    pairs = [(s, f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for s, n in ((1, 20), (2, 5), (3, 2)) for _ in range(20)]
    asked = spark.createDataFrame(pairs, "scan int, src string, dst string").distinct()
    rows = lambda df: sorted((r.scan, r.src, r.dst, r.d, r.hops, tuple(r.path)) for r in df.collect())
    lone = [(3, a, a, 0.0, 0, (a,)) for a in sorted({a for s, a, b in pairs if s == 3 and a == b})]
    want = [r for r in rows(G.asked_paths(edges, asked)) if r[0] != 3] + lone
    assert rows(G._asked_by_joins(edges, asked, block)) == want


def test_nodes_at_one_place_by_joins(spark, block=2):
    """Steps of no length: labels of whole ways went round between such nodes without an end."""
    both = [(9, 2, 1.0), (2, 1, 0.0), (1, 3, 0.0), (2, 3, 0.0), (3, 4, 1.0), (4, 0, 0.0)]
    links = [(1, *e) for a, b, w in both for e in ((a, b, w), (b, a, w))]
    edges = spark.createDataFrame(links, "scan int, src long, dst long, w double")
    asked = spark.createDataFrame([(1, a, b) for a in (9, 2, 1) for b in (0, 1, 2, 3, 4, 9)], "scan int, src long, dst long")
    got = G._asked_by_joins(edges, asked, block).collect()
    w = {(a, b): x for _, a, b, x in links}
    assert len(got) == 18
    for r in got:
        assert r.path[0] == r.src and r.path[-1] == r.dst and len(set(r.path)) == len(r.path) == r.hops + 1
        assert sum(w[e] for e in zip(r.path, r.path[1:])) == r.d == dijkstra([x[1:] for x in links], r.src)[r.dst]
