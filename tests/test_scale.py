"""Forms that keep work, memory and shuffles in proportion to the input."""

import contextlib
import io
import math
import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailweave.functions import geometry
from trailweave.operators import annotate, memory, meteor, observations
from trailweave.operators import textmetrics as M
from trailweave.streaming import memory as stream_memory
from trailweave.streaming import shards, topology


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue()


def test_bleu_counts_cross_as_texts_only(spark):
    rows = spark.createDataFrame([(1, "a b a b c", ["a b c", "b a b"]), (2, "", ["x"]), (3, "x", [""])], "id long, hyp string, refs array<string>")
    counts = M.bleu_counts(rows, most_refs=2)
    made = plan(counts)
    # a stated number of tasks, which adaptive execution leaves alone; no n-gram is a row
    assert made.count("Exchange") == 1 and "REPARTITION_BY_NUM" in made and "Generate" not in made
    got = {r.id: (r.testlen, [r[f"guess{n}"] for n in M.ORDERS], [r[f"correct{n}"] for n in M.ORDERS]) for r in counts.collect()}
    assert got == {1: (5, [5, 4, 3, 2], [4, 3, 2, 0]), 2: (0, [0] * 4, [0] * 4), 3: (1, [1, 0, 0, 0], [0] * 4)}


def test_cider_counts_ids_where_rows_meet(spark):
    rows = spark.createDataFrame([(k, f"a b w{k}", ["a b", f"b w{k}"]) for k in range(40)], "id long, hyp string, refs array<string>")
    scored = M.cider(rows, most_refs=2)
    made = plan(scored)
    assert "Window" in made and made.count("REPARTITION_BY_NUM") >= 2 and "Generate" not in made
    assert len({round(r.cider, 9) for r in scored.collect()}) == 1


def test_cider_sends_a_buckets_key_once(spark):
    """The same words in every id cross once for all ids of a bucket, not once for each."""
    rows = spark.createDataFrame([(k, "a b c d", ["a b c d", "d c b a"]) for k in range(300)] + [(300, "x", ["y"]), (301, "", [""])], "id long, hyp string, refs array<string>")
    scored = M.cider(rows).collect()
    assert len(scored) == 302 and {r.id: r.cider for r in scored}[301] == 0
    f = pd.DataFrame({"id": range(3), "one": [[np.arange(4), np.arange(4), np.arange(4)[::-1]]] * 3, "two": [[np.arange(4), np.arange(4), np.arange(4)[::-1]]] * 3})
    c = M._Counted(f)
    assert len(c.h1) == 4 + 6 + 4 + 2 and set(c.in_references()) == {3}


@pytest.mark.parametrize("given", [False, True])
def test_cider_of_several_buckets(spark, monkeypatch, given):
    """Against sums by hand, with unlike numbers of references, empty texts, and frequencies above the number of documents."""
    monkeypatch.setattr(M, "IDS_OF_A_BUCKET", 7)
    rng = random.Random(4)
    some = lambda: " ".join(rng.choices("abcdef", k=rng.randrange(9)))
    rows = [(k, some(), [some() for _ in range(rng.randint(1, 4))]) for k in range(40)]
    grams = lambda t: [Counter(" ".join(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)) for n in (1, 2, 3, 4)]
    df = Counter(g for _, _, refs in rows for g in {g for r in refs for c in grams(r) for g in c})
    of = 3.0 if given else 40.0

    def slow(hyp, refs):
        weighed = lambda t: [{g: n * (math.log(of) - math.log(max(1, df[g]))) for g, n in c.items()} for c in grams(t)]
        total, h = 0.0, weighed(hyp)
        for r in refs:
            off = max(0, len(hyp.split()) - 1) - max(0, len(r.split()) - 1)
            for a, b in zip(h, weighed(r)):
                dot = sum(min(a[g], b[g]) * b[g] for g in a if g in b)
                norm = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
                total += (dot / norm if norm else dot) * math.exp(-off * off / 72)
        return total / 4 / len(refs) * 10

    frame = spark.createDataFrame(rows, "id long, hyp string, refs array<string>")
    got = M.cider(frame, M.document_frequency(frame), of) if given else M.cider(frame)
    assert {r.id: r.cider for r in got.collect()} == pytest.approx({k: slow(h, r) for k, h, r in rows})


def test_equal_words_are_counted_without_a_search(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "a b a c " * 3 + f"w{k}", ["a a b " * 3, f"c w{k} c"]) for k in range(30)], "id long, hyp string, refs array<string>")
    searched = meteor.counts(rows, stemmed=False)
    counted = meteor.equal_counts(rows)
    assert sorted(counted.collect()) == sorted(searched.select(counted.columns).collect())


def test_meteor_is_dealt_to_a_stated_number_of_tasks(spark):
    rows = spark.createDataFrame([(k, "the cats sit", ["the cat sat"]) for k in range(8)], "id long, hyp string, refs array<string>")
    assert "REPARTITION_BY_NUM" in plan(meteor.counts(rows))


def test_a_long_pair_is_aligned_in_short_time():
    words = [f"w{k % 12}" if k % 2 else f"u{k}" for k in range(200)]
    turned = words[:6] + words[6:][::-1]
    t = time.process_time()
    for _ in range(20):
        found = meteor.aligned(words, words, turned, turned)
    assert len(found) == 200 and (time.process_time() - t) / 20 < 0.05


def test_ways_of_all_pairs_at_once():
    rng = random.Random(3)
    for _ in range(30):
        m = memory.GraphMemory()
        for step in range(8):
            at = rng.randrange(12)
            for to in rng.sample(range(12), 4):
                m.see(at, to, rng.randint(1, 30) / 4)
            m.visit(at, step)
        names = sorted(m.names)
        want = [(a, b, m.distance(a, b), len(m.path(a, b))) for k, a in enumerate(names) for b in names[k + 1 :] if m.distance(a, b) < memory.UNKNOWN]
        assert list(zip(*(list(x) for x in m.pairs()))) == want


def test_pooled_needs_one_exchange(spark):
    visits = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 4.0)], "instr_id string, node long, v double")
    seen = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 1.0), ("a", 2, 2.0)], "instr_id string, node long, v double")
    p = memory.pooled(visits, seen, "v")
    assert plan(p).count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan(p)
    assert sorted(map(tuple, p.collect())) == [("a", 1, True, 3.0), ("a", 2, False, 1.5)]


def test_topology_state_comes_and_goes_once_a_trigger(spark):
    """A trajectory's entries are one state: no call to the store for each of them."""
    stream = spark.readStream.format("rate").load()
    seen = stream.selectExpr("'a' AS instr_id", "value AS pos", "value AS node", "array(value + 1) AS nbrs", "1.0 AS value", "false AS rewrite", "value AS scene", "value AS thing")
    made = plan(topology.topology_memory(seen))
    assert "FlatMapGroupsInPandasWithState" in made and "TransformWithState" not in made


def test_topology_entries_over_triggers():
    steps = pd.DataFrame([("a", 0, 1, [2, 3], 1.0, False, 5, None), ("a", 1, 2, [1], 3.0, False, None, 7), ("a", 2, 1, [2], 4.0, True, None, None)], columns=["instr_id", "pos", "node", "nbrs", "value", "rewrite", "scene", "thing"])
    whole, parts = {}, {}
    topology.walked(whole, steps)
    assert set(topology.walked(parts, steps[:1])) == {1, 2, 3}
    parts = topology._read(topology._written(parts))
    assert set(topology.walked(parts, steps[1:2])) == {1, 2}
    topology.walked(parts, steps[2:])
    assert parts == whole and whole[1]["total"] == 4.0 and whole[1]["traj_order"] == 2 and whole[1]["s_env"] == 5 and whole[3] == {**topology.NEW, "first_seen": 0, "links": {1}}


def test_an_instruction_carries_its_own_encoding_only(spark):
    r = spark.createDataFrame([(7, 7, None, ["a b", "c", "d"], [[1, 2, 3], [4]]), (3, 3, 1.5, ["x"], [[5], [6]]), (4, 4, 0.5, ["y"], None)], "raw_idx long, path_id long, heading double, instructions array<string>, instr_encodings array<array<int>>")
    made = annotate.instruction_rows(r, 2)
    # the nested encodings end where instructions become rows, before these are dealt and put in order
    assert "instr_encodings" not in made._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    got = {x.instr_id: (x.sample_idx, x.instruction, x.instr_encoding, x.heading) for x in made.collect()}
    assert got == {"r2r_3_0": (0, "x", [5], 1.5), "r2r_4_0": (1, "y", None, 0.5), "r2r_7_0": (2, "a b", [1, 2], 0.0), "r2r_7_1": (3, "c", [4], 0.0), "r2r_7_2": (4, "d", None, 0.0)}


def test_last_visits(spark):
    """One row per viewpoint meets what it sees."""
    steps = spark.createDataFrame([("s", 1, 0, 5, 9), ("s", 1, 1, 0, 2), ("s", 1, 1, 0, 3), ("s", 2, 0, 0, 1)], "scan string, vp long, week long, pos long, user_id long")
    assert sorted(map(tuple, observations.last_visits(steps, ["week", "pos", "user_id"]).collect())) == [("s", 1, 1, 0, 3), ("s", 2, 0, 0, 1)]


def test_known_pairs_come_in_batches_of_many_trajectories(spark, monkeypatch):
    """No call for each trajectory; one whose steps lie in several batches is still one, and large ones leave in parts."""
    monkeypatch.setattr(memory, "BATCH_ROWS", 10)
    rng = random.Random(8)
    see = lambda: sorted((rng.randrange(15), rng.randint(1, 40) / 4) for _ in range(rng.randrange(5)))
    rows = [(i, p, rng.randrange(15), see()) for i, n in ((None, 3), ("a", 1), ("b", 25), ("c", 9)) for p in range(n)]
    seen = spark.createDataFrame(rows, "instr_id string, pos long, node long, nbrs array<struct<dst: long, w: double>>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        known = memory.remembered(seen)
        assert "MapInArrow" in plan(known) and "FlatMapGroups" not in plan(known)
        got = sorted(map(tuple, known.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for i in (None, "a", "b", "c"):
        m = memory.GraphMemory()
        for _, p, node, nbrs in (r for r in rows if r[0] == i):
            for dst, w in nbrs:
                m.see(node, dst, w)
            m.visit(node, p)
        want += [(i, *x) for x in zip(*(list(c) for c in m.pairs()))]
    assert got == sorted(want, key=repr)


def test_memory_of_a_building_is_quick():
    """Some 180 viewpoints known after 13 steps with 55 neighbours each."""
    rng = random.Random(6)
    at = {v: [rng.random() for _ in range(3)] for v in range(200)}
    near = {v: sorted(at, key=lambda u: math.dist(at[u], at[v]))[1:56] for v in at}
    walks = [[rng.randrange(200) for _ in range(13)] for _ in range(30)]

    def walked(walk):
        m = memory.GraphMemory()
        for step, v in enumerate(walk):
            m.look(v, near[v], np.array([math.dist(at[u], at[v]) for u in near[v]]))
            m.visit(v, step)
        return m.ways()

    assert walked(walks[0])[2].shape[0] > 5000
    t = time.process_time()
    for w in walks:
        walked(w)
    assert (time.process_time() - t) / len(walks) < 0.015


def test_rounding_without_decimals(spark):
    ties = [k / 2e6 for k in range(-40, 40)] + [0.0000005, 1.0000005, 2.5e-7, 999999.9999995, 1e6 + 0.1234565, 1e300, -1e15, float("nan"), float("inf"), None, 0.1234564999999, 0.12345650000001]
    rng = random.Random(2)
    df = spark.createDataFrame([(x,) for x in ties + [rng.random() * 10 ** rng.randint(-8, 7) for _ in range(2000)]], "x double")
    assert df.where(~geometry.rounded(F.col("x")).eqNullSafe(F.round("x", 6))).count() == 0
    assert "CASE WHEN" in plan(df.select(geometry.rounded(F.col("x"))))


class Kept:
    """A group's state, by hand."""

    def __init__(self):
        self.value, self.now, self.timeout = None, 0, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)
    hasTimedOut = property(lambda self: self.timeout is not None and self.timeout <= self.now)  # noqa: N815

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def getCurrentProcessingTimeMs(self):  # noqa: N802
        return self.now

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.timeout = self.now + ms


def test_trajectories_of_a_shard_keep_apart_and_run_out_alone():
    def step(instr, held, rows, now):
        after = (held or b"") + b"".join(r[1].encode() for r in rows)
        return after, [(instr, after.decode())]

    run, state = shards.runner(step, ["instr_id", "pos", "what"], ["instr_id", "said"], 100), Kept()
    news = lambda now, *rows: setattr(state, "now", now) or [tuple(r) for f in run((0,), iter([pd.DataFrame(rows, columns=["instr_id", "pos", "what"])] if rows else []), state) for r in f.itertuples(index=False)]
    assert news(1000, ("b", 1, "y"), ("a", 0, "p"), ("b", 0, "x")) == [("b", "xy"), ("a", "p")]
    assert news(1060, ("a", 1, "q")) == [("a", "pq")] and state.timeout == 1100
    assert news(1100) == [] and state.value[0] == ["a"] and state.timeout == 1160
    assert news(1101, ("b", 2, "z")) == [("b", "z")]
    assert news(1300) == [] and not state.exists


def test_steps_as_bytes():
    see = lambda *k: (np.array(k, np.int64), np.array(k) / 4)
    steps = [(0, 5, *see(1, 2, 3)), (1, 6, *see()), (2, 5, *see(1, 2, 3)), (3, 5, *see(1, 2)), (4, 5, *see(1, 2))]
    data = stream_memory.written(steps)
    assert len(data) == 8 + 24 * 5 + 16 * 5  # the third and the fifth see what was seen before
    back = stream_memory.read(data)
    assert [(p, v, d.tolist(), w.tolist()) for p, v, d, w in back] == [(p, v, d.tolist(), w.tolist()) for p, v, d, w in steps]
    assert stream_memory.written(back) == data


def test_stream_of_graph_memories(spark, tmp_path):
    """After each trigger what a memory knows, in shards of several trajectories."""
    rng = random.Random(12)
    see = lambda: sorted((rng.randrange(15), rng.randint(1, 40) / 4) for _ in range(rng.randrange(5)))
    rows = [(f"i{k}", p, rng.randrange(15), see()) for k in range(30) for p in range(rng.randint(1, 9))]
    seen = spark.createDataFrame(rows, "instr_id string, pos long, node long, nbrs array<struct<dst: long, w: double>>")
    made = plan(stream_memory.graph_memory(spark.readStream.schema(seen.schema).parquet(str(tmp_path))))
    assert "FlatMapGroupsInPandasWithState" in made and "hashpartitioning(shard#" in made
    for lo, hi in ((0, 2), (2, 9)):
        seen.where(f"pos >= {lo} AND pos < {hi}").write.mode("append").parquet(f"{tmp_path}/seen")
        source = spark.readStream.schema(seen.schema).parquet(f"{tmp_path}/seen")
        out = stream_memory.drained(spark, stream_memory.graph_memory(source, shards=3), f"{tmp_path}/run", "update", stream_memory.GRAPH_OUT)
    got = {(r.instr_id, r.batch): (r.n_known, r.n_visited, round(r.total, 6), r.last) for r in out.collect()}
    want = {}
    for batch, most in ((0, 2), (1, 9)):
        for i in {r[0] for r in rows if batch == 0 or r[1] >= 2}:
            m = memory.GraphMemory()
            walk = [r for r in rows if r[0] == i and r[1] < most]
            for _, p, node, nbrs in walk:
                for dst, w in nbrs:
                    m.see(node, dst, w)
                m.visit(node, p)
            want[i, batch] = (len(m.names), len(m.visited), round(sum(m.pairs()[2]), 6), walk[-1][1])
    assert got == want


def test_stream_of_topology_memories(spark, tmp_path):
    """Trajectories of a shard over two triggers, as if each were walked at once."""
    rng = random.Random(14)
    rows = [(f"i{k}", p, rng.randrange(15), rng.sample(range(15), rng.randrange(5)), rng.random(), rng.random() < 0.2, rng.choice([None, p]), rng.choice([None, p * 10])) for k in range(30) for p in range(rng.randint(1, 9))]
    seen = spark.createDataFrame(rows, "instr_id string, pos long, node long, nbrs array<long>, value double, rewrite boolean, scene long, thing long")
    memories = lambda: topology.topology_memory(spark.readStream.schema(seen.schema).parquet(f"{tmp_path}/seen"), shards=3)
    with topology.keyed_maps(spark):
        for lo, hi in ((0, 2), (2, 9)):
            seen.where(f"pos >= {lo} AND pos < {hi}").write.mode("append").parquet(f"{tmp_path}/seen")
            out = stream_memory.drained(spark, memories(), f"{tmp_path}/run", "update", topology.OUT)
    assert "hashpartitioning(shard#" in plan(memories())
    got = {(r.batch, r.instr_id, r.node): tuple(r)[2:11] for r in out.collect()}
    want = {}
    for i in {r[0] for r in rows}:
        entries = {}
        for batch, (lo, hi) in enumerate(((0, 2), (2, 9))):
            part = pd.DataFrame([r for r in rows if r[0] == i and lo <= r[1] < hi], columns=seen.columns)
            for node, e in topology.walked(entries, part).items() if len(part) else ():
                want[batch, i, node] = (e["visited"], e["traj_order"], e["first_seen"], e["s_env"], e["d_env"], e["total"] / e["n"] if e["n"] else None, e["most"], e["n"], len(e["links"]))
    assert got == want


def test_topology_of_a_building_is_quick():
    """Some 200 entries met in 13 steps with 55 neighbours each, kept and read in every trigger."""
    rng = random.Random(6)
    walks = [[(p, rng.randrange(200), rng.sample(range(200), 55), 1.0, False, p, None) for p in range(13)] for _ in range(30)]
    t = time.process_time()
    for steps in walks:
        held = None
        for lo, hi in ((0, 2), (2, 5), (5, 13)):
            entries = topology._read(held) if held else {}
            topology.walked(entries, steps[lo:hi])
            held = topology._written(entries)
        assert len(held) < 6000
    assert (time.process_time() - t) / len(walks) < 0.01
