"""Walks, memories, stores and files against plain versions."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.functions import arrays
from trailweave.operators import memory as M
from trailweave.operators import observations as O
from trailweave.sources import catalog, sinks

EDGES = "scan string, src long, dst long, w double"


def graph(seed, n=25):
    rnd = random.Random(seed)
    at = {v: (rnd.random(), rnd.random()) for v in range(n)}
    far = lambda a, b: math.dist(at[a], at[b])
    return [("s", a, b, far(a, b)) for a in at for b in at if a != b and far(a, b) < 0.35]


def known_distances(edges, visits):
    """What a memory knows: all pairs through the viewpoints visited, relaxed once at each visit."""
    d = {}
    for at in visits:
        for _, a, b, w in edges:
            if a == at and w < d.get((a, b), math.inf):
                d[a, b] = d[b, a] = w
        names = {x for pair in d for x in pair}
        for a in names:
            for b in names:
                if a != b and d.get((a, at), math.inf) + d.get((at, b), math.inf) < d.get((a, b), math.inf):
                    d[a, b] = d[a, at] + d[at, b]
    return d


def test_remembered_distances_against_a_plain_memory(spark):
    edges = graph(1)
    rnd = random.Random(2)
    nodes = sorted({e[1] for e in edges})
    walks = {f"i{k}": [rnd.choice(nodes) for _ in range(rnd.randint(1, 8))] for k in range(12)}
    steps = spark.createDataFrame([(i, "s", p, v) for i, w in walks.items() for p, v in enumerate(w)], "instr_id string, scan string, pos long, node long")
    got = {}
    for r in M.remembered(M.observed(steps, spark.createDataFrame(edges, EDGES))).collect():
        got.setdefault(r.instr_id, {})[r.src, r.dst] = r.d
    for i, w in walks.items():
        assert got.get(i, {}) == pytest.approx({p: d for p, d in known_distances(edges, w).items() if p[0] < p[1]})


def test_memory_survives_being_written():
    m = M.GraphMemory()
    for a, b, w in ((1, 2, 1.0), (2, 3, 1.5)):
        m.see(a, b, w)
        m.visit(a, step=a)
        m.embed(a, np.array([a, 2.0]))
    m.embed(1, np.array([3.0, 4.0]))
    back = M.GraphMemory.load(m.dump())
    assert back.step_of == m.step_of and back.visited == m.visited and back.names == m.names
    assert back.distance(1, 3) == m.distance(1, 3) and back.path(1, 3) == m.path(1, 3)
    assert back.embedding(1).tolist() == [2.0, 3.0] and back.sums[1][1] == 2
    back.see(3, 4, 1.0)
    back.visit(3)
    assert back.distance(1, 4) == 3.5


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jumps_arrive_by_the_shortest_way(spark, seed):
    edges = graph(seed)
    near = {}
    for _, a, b, w in edges:
        near.setdefault(a, []).append((b, w))

    def shortest(a):
        out, heap = {}, [(0.0, a)]
        while heap:
            d, v = heapq.heappop(heap)
            if v not in out:
                out[v] = d
                for b, w in near.get(v, []):
                    heapq.heappush(heap, (d + w, b))
        return out

    nodes = sorted(near)
    starts = [(f"i{k}", "s", a, b) for k, (a, b) in enumerate((a, b) for a in nodes[:6] for b in [*nodes[-6:], 99])]
    got = {r.instr_id: r for r in M.jump_rollout(spark.createDataFrame(starts, "instr_id string, scan string, start long, goal long"), spark.createDataFrame(edges, EDGES), 60).collect()}
    linked = {(a, b) for _, a, b, _ in edges}
    for i, _, a, b in starts:
        way = [v for s in got[i].segments for v in s]
        assert way[0] == a and way[-1] == got[i].cur and all(p in linked for p in zip(way, way[1:]))
        if b in shortest(a):
            assert got[i].arrived and got[i].moved == pytest.approx(shortest(a)[b])
        else:
            assert not got[i].arrived


def test_at_most_so_many_choices(spark):
    edges = [("s", a, b, 1.0) for k in range(9) for a, b in ((k, k + 1), (k + 1, k))]
    r = M.jump_rollout(spark.createDataFrame([("i", "s", 0, 9)], "instr_id string, scan string, start long, goal long"), spark.createDataFrame(edges, EDGES), 4).first()
    assert (r.cur, r.arrived, r.segments) == (4, False, [[0], [1], [2], [3], [4]])


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(new[-1], row[k + 1]))
        row = new
    return row[-1]


def test_common_subsequences(spark):
    rnd = random.Random(3)
    rows = [([rnd.choice("abcd") for _ in range(rnd.randint(0, 90))], [rnd.choice("abcd") for _ in range(rnd.randint(0, 90))]) for _ in range(200)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert [r.n for r in df.select(arrays.lcs_length("a", "b").alias("n")).collect()] == [slow_lcs(a, b) for a, b in rows]


def test_words_part_at_unicode_white_space(spark):
    text = "a\u00a0b\u2003c\x1cd\u3000\u0085 e"
    r = spark.createDataFrame([(text, f"\u00a0 {text}\u2028")], "t string, s string").select(arrays.words("t").alias("w"), arrays.stripped("s").alias("s")).first()
    assert r.w == text.split() == list("abcde") and r.s == text


def test_left_cut_and_padding(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([],)], "a array<int>")
    r = df.select(arrays.padded(arrays.last_tokens(F.col("a"), 3), 5, F.lit(0), True).alias("p"), arrays.length_mask(arrays.last_tokens(F.col("a"), 3), 5, True).alias("m")).collect()
    assert (r[0].p, r[0].m) == ([0, 0, 2, 3, 4], [False, False, True, True, True]) and (r[1].p, any(r[1].m)) == ([0] * 5, False)


def test_finite_parameters(spark):
    p = spark.createDataFrame([(k, f"p{k}", [1.0, float("nan") if k % 2 else 2.0]) for k in range(60)], "position long, name string, values array<double>")
    assert [r.name for r in O.first_nonfinite(p).collect()] == [f"p{k}" for k in range(1, 40, 2)]
    assert O.checked_finite(p.where("position % 2 = 0")).count() == 30
    with pytest.raises(Exception, match="not finite: p1"):
        O.checked_finite(p.where("position < 2")).collect()


def test_stores_by_name(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/one")
    c = catalog.Catalog(spark, {"a": "one", "b": f"{tmp_path}/one"}, str(tmp_path))
    assert c.store("a") is c.store("a") and c.store("b").count() == 3
    with pytest.raises(ValueError, match="no feature store"):
        c.store("c")
    assert "other" not in catalog.object_catalog(spark, {"soon": "one", "other": "one"}, str(tmp_path))


def test_files(spark, tmp_path):
    (tmp_path / "answers.json").write_text('["yes", "no"]')
    assert [tuple(r) for r in catalog.vocabulary(spark, f"{tmp_path}/answers.json").orderBy("place").collect()] == [(0, "yes"), (1, "no")]
    (tmp_path / "c.json").write_text('{"a": {"b": 1}}')
    assert catalog.read_config(spark, f"{tmp_path}/c.json") == {"a": {"b": 1}}
    for folder, names in (("train", "ab"), ("val", "bc")):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / f"{n}.jpg").write_bytes(folder.encode())
    wanted = spark.createDataFrame([(n, f"{n}.jpg") for n in "abcd"], "id string, image string")
    got = {r.id: r.content and bytes(r.content) for r in catalog.images(spark, wanted, [f"{tmp_path}/train", f"{tmp_path}/val"]).collect()}
    assert got == {"a": b"train", "b": b"train", "c": b"val", "d": None}


def test_features_and_metadata_stay_aligned(spark, tmp_path):
    df = spark.createDataFrame([(f"k{k}", k % 3, [float(k)]) for k in range(200)], "key string, kind int, ft array<double>").repartition(7)
    sinks.write_features(df, str(tmp_path), ["ft"], ["key"])
    meta = {r.row: r.key for r in spark.read.json(f"{tmp_path}/metadata").collect()}
    assert sorted(meta) == list(range(200))
    assert {r.row: r.key for r in spark.read.parquet(f"{tmp_path}/features").collect()} == meta


def test_candidates_of_a_batch_model(spark):
    def model():
        return lambda pdf: {"double": pdf["x"] * 2}

    assert [r.double for r in O.extracted(spark.range(5).select("id", (F.col("id") + 1).alias("x")), model, ["x"], "id long, double long").orderBy("id").collect()] == [2, 4, 6, 8, 10]

