"""Expressions, text scores, annotation rows, sampling and memory on literal cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.functions import arrays as A
from trailweave.functions import geometry as G
from trailweave.operators import annotate, candidates, memory, prompts, sampling
from trailweave.operators import textmetrics as M
from trailweave.sources import annotations, sinks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_tokens(spark):
    r = one(spark, A.words(F.lit(" a  b\n")).alias("w"), A.spaced(F.lit("a  b")).alias("s"), A.words(F.lit("")).alias("e"), A.ngrams(A.words(F.lit("a b c")), 2).alias("g"), A.ngrams(A.words(F.lit("a")), 2).alias("h"))
    assert (r.w, r.s, r.e, r.g, r.h) == (["a", "b"], ["a", "", "b"], [], ["a b", "b c"], [])


def test_lcs(spark):
    rnd = random.Random(2)
    rows = [([rnd.choice("abc") for _ in range(rnd.randint(0, 9))], [rnd.choice("abc") for _ in range(rnd.randint(0, 9))]) for _ in range(40)]

    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert all(r.n == slow(r.a, r.b) for r in df.withColumn("n", A.lcs_length(F.col("a"), F.col("b"))).collect())


def test_run_lengths_and_padding(spark):
    r = one(spark, A.run_lengths(F.array(F.array(F.lit(0), F.lit(2)), F.array(F.lit(2), F.lit(3)))).alias("r"), A.padded(F.array(F.lit(5)), 3, F.lit(0)).alias("p"), A.length_mask(F.array(F.lit(5)), 2).alias("m"))
    assert (r.r, r.p, r.m) == ([0, 0, 1], [5, 0, 0], [True, False])


def test_angles(spark):
    x = F.lit(-math.pi / 2)
    r = one(spark, G.normalised_angle(x).alias("n"), G.heading_fraction(x).alias("h"), G.normalised_angle(F.lit(math.pi)).alias("p"))
    assert r.n == pytest.approx(-math.pi / 2) and r.h == pytest.approx(0.75) and r.p == pytest.approx(math.pi)


def test_truth_and_lines(spark):
    r = one(spark, A.truth(F.lit("Yes")).alias("y"), A.truth(F.lit("0")).alias("n"), A.one_line(F.lit("a\n|||b\t")).alias("l"), A.one_line(F.lit("")).alias("e"))
    assert (r.y, r.n, r.l, r.e) == (True, False, "a b", " ")
    with pytest.raises(Exception, match="boolean"):
        one(spark, A.truth(F.lit("maybe")))


def test_scores(spark):
    rows = spark.createDataFrame([(1, "a b c d e", ["a b c d e"]), (2, "x y", ["a b", "x z y"])], "id long, hyp string, refs array<string>")
    b = {r.id: r for r in M.bleu_sentences(M.bleu_counts(rows)).collect()}
    assert b[1].bleu4 == pytest.approx(1) and 0 < b[2].bleu1 < 1
    r = {x.id: x.rouge_l for x in M.rouge_l(rows).collect()}
    assert r[1] == pytest.approx(1)
    assert M.cider(rows.where("id = 1")).first().cider == 0  # one id alone: every weight is 0
    lengths = one(spark, M.reference_length(F.lit(5), F.array(F.lit(6), F.lit(4)), "closest").alias("c"))
    assert lengths.c == 4
    with pytest.raises(Exception, match="differ in ids"):
        M.paired(rows.select("id", "hyp").where("id = 1"), rows.select("id", "refs")).collect()


def test_dialogs(spark):
    def text(turns):
        h = F.array(*(F.struct(F.lit(a).alias("role"), F.lit(b).alias("message")) for a, b in turns)) if turns else F.array().cast("array<struct<role:string,message:string>>")
        return spark.range(1).withColumn("h", h).select(annotate.dialog_text(F.lit("bed"), "h").alias("t")).first().t

    assert text([]) == "The goal room contains a bed."
    assert text([("navigator", "left"), ("oracle", "yes.")]) == "The goal room contains a bed.\nQuestion: left.\nAnswer: yes."
    with pytest.raises(Exception, match="unknown role"):
        text([("system", "x")])


def test_rows_of_records(spark):
    r = spark.createDataFrame([(0, 5, "s", ["p"], None, ["go", "stop"], [[1, 2, 3], [4]]), (1, 6, "s", ["p"], 2.0, [], [])], "raw_idx long, path_id long, scan string, path array<string>, heading double, instructions array<string>, instr_encodings array<array<int>>")
    got = annotate.instruction_rows(r, 2).orderBy("sample_idx").collect()
    assert [(x.instr_id, x.sample_idx, x.heading, x.instr_encoding) for x in got] == [("r2r_5_0", 0, 0.0, [1, 2]), ("r2r_5_1", 1, 0.0, [4])]
    o = spark.createDataFrame([(0, 5, None, "s", 3, ["look"]), (1, None, "x9", "s", None, ["find"])], "raw_idx long, path_id long, id string, scan string, objid long, instructions array<string>")
    v = spark.createDataFrame([("s", 3, ["v1"])], "scan string, objid long, end_vps array<string>")
    assert {(x.instr_id, tuple(x.end_vps or ())) for x in annotate.object_rows(o, v).collect()} == {("reverie_5_3_0", ("v1",)), ("reverie_x9_0", ())}
    with pytest.raises(Exception, match="no viewpoint shows"):
        annotate.object_rows(o, v.limit(0)).collect()
    odd = spark.createDataFrame([("1", "a.b.jpg", [("human", "<image>\nhi "), ("gpt", "yo")])], "id string, image string, conversations array<struct<`from`:string,value:string>>")
    assert tuple(annotate.turn_pair_rows(odd).first()) == ("1", "a", "hi", ["yo"])
    with pytest.raises(Exception, match="not a human"):
        annotate.turn_pair_rows(odd.withColumn("conversations", F.slice("conversations", 1, 1))).collect()


def test_literal_lists(spark):
    df = spark.createDataFrame([("[[['turn', \"don't\"], ['stop']]]", 0)], "new_instructions string, j int").withColumn("chunk_view", F.array(F.array(F.array(F.lit(0), F.lit(2)))))
    r = annotate.fine_grained(df).first()
    assert r.fg_instruction == ["turn don't", "stop"] and r.fg_view == [0, 0]


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"scan": "s", "path_id": 1, "instructions": ["x"]}, {"scan": "t", "path_id": 2, "instructions": []}]')
    (tmp_path / "b.jsonl").write_text('{"scan": "s", "path_id": 1}\n{"scan": "t", "path_id": 2}\n')
    for name in ("a.json", "b.jsonl"):
        got = annotations.records(spark, str(tmp_path / name), "r2r").orderBy("raw_idx").collect()
        assert [(r.raw_idx, r.scan, r.path_id, r.heading) for r in got] == [(0, "s", 1, None), (1, "t", 2, None)]
    (tmp_path / "boxes.json").write_text('{"s_v1": {"3": {"visible_pos": [1]}, "4": {"visible_pos": []}}}')
    v = annotate.object_viewpoints(annotations.visible_boxes(spark, str(tmp_path / "boxes.json"))).collect()
    assert [tuple(r) for r in v] == [("s", "3", ["v1"])]
    pose = [1, 0, 0, 7, 0, 1, 0, 8, 0, 0, 1, 9, 0, 0, 0, 1]
    (tmp_path / "s1_connectivity.json").write_text(str([{"image_id": "p", "included": True, "unobstructed": [False], "pose": pose}]).replace("'", '"').replace("True", "true").replace("False", "false"))
    c = annotations.connectivity(spark, str(tmp_path / "*_connectivity.json")).first()
    assert (c.scan, c.pos, c.vp, c.x, c.y, c.z) == ("s1", 0, "p", 7, 8, 9)
    (tmp_path / "m.txt").write_text("1 2\n3 4.5\n")
    assert annotations.matrix(spark, str(tmp_path / "m.txt")).first().rows == [[1.0, 2.0], [3.0, 4.5]]
    assert {r.name for r in annotations.listing(spark, str(tmp_path), "*", ".json").collect()} == {"b.jsonl", "m.txt"}
    sinks.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first().value == '{"a":1,"b":null}'


def test_config():
    assert annotations.resolved("/d", "x", "f") == "/d/x/f" and annotations.resolved("/d", "/x", "f") == "/x/f"
    assert annotations.merged_config({"a": 1}, {"a": 2}) == {"a": 2} and annotations.chosen_tasks(None, ["t"], ["c"]) == ["t"]
    assert annotations.mixture(["a", "b"], {"a", "b"}, {"b": 3}) == {"a": 1.0, "b": 3.0}
    with pytest.raises(ValueError, match="unknown"):
        annotations.mixture(["z"], {"a"})


def test_features_and_objects(spark):
    store = spark.createDataFrame([("s", "v", [1.0, 2.0, 3.0])], "scan string, vp string, ft array<double>")
    want = spark.createDataFrame([("s", "v")], "scan string, vp string")
    assert annotations.features(store, want, ["scan", "vp"], 2).first().ft == [1.0, 2.0]
    with pytest.raises(Exception, match="no feature"):
        annotations.features(store, want.withColumn("vp", F.lit("w")), ["scan", "vp"], 2).collect()
    assert annotations.object_features(store.withColumnRenamed("ft", "objects"), want.withColumn("vp", F.lit("w")), ["scan", "vp"]).first().objects == []


def test_prompts(spark):
    r = one(spark, prompts.numbered(F.lit(3), "<cand>", "stop").alias("a"), prompts.numbered(F.lit(0), "<hist>").alias("b"), prompts.navigation("r2r", F.lit("go"), F.lit(1), F.lit(2)).alias("p"))
    assert (r.a, r.b) == ("(0) stop (1) <cand> (2) <cand>", "") and r.p.startswith("### Instruction: Navigate following the instruction. go \n") and r.p.endswith("### Output: <cls>")
    with pytest.raises(Exception, match="no prompt"):
        one(spark, prompts.by_task(F.lit("zz"), {"r2r": F.lit("x")}))


def test_sampling(spark):
    draws = sampling.drawn_tasks(spark, 4000, {"a": 3, "b": 1}, 1)
    share = draws.where("task = 'a'").count() / 4000
    assert 0.72 < share < 0.78 and draws.exceptAll(sampling.drawn_tasks(spark, 4000, {"a": 3, "b": 1}, 1)).count() == 0
    r = spark.range(10).select("id", sampling.contiguous_part(F.col("id"), 10, 3).alias("w")).collect()
    assert [x.w for x in r] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]


def test_memory_against_floyd():
    rnd = random.Random(3)
    for _ in range(20):
        n, m = 9, memory.GraphMemory()
        w = {(a, b): rnd.uniform(1, 9) for a in range(n) for b in range(a) if rnd.random() < 0.5}
        order = rnd.sample(range(n), 6)
        for k in order:
            for (a, b), x in w.items():
                if k in (a, b):
                    m.see(a, b, x)
            m.visit(k)
        d = np.full((n, n), np.inf)
        for (a, b), x in w.items():
            if a in order or b in order:
                d[a, b] = d[b, a] = x
        np.fill_diagonal(d, 0)
        for k in order:
            d = np.minimum(d, d[:, k, None] + d[None, k, :])
        for a in range(n):
            for b in range(n):
                known = m.distance(a, b)
                assert known == pytest.approx(d[a, b]) if np.isfinite(d[a, b]) else known == memory.UNKNOWN
                if a != b and np.isfinite(d[a, b]):
                    way = [a, *m.path(a, b)]
                    assert sum(w.get((x, y), w.get((y, x))) for x, y in zip(way, way[1:])) == pytest.approx(known)
        again = memory.GraphMemory.load(m.dump())
        assert again.distance(0, 1) == m.distance(0, 1) and again.visited == m.visited
    assert memory.GraphMemory().path("x", "y") == ["y"]


def test_embeddings_of_memory():
    m = memory.GraphMemory()
    for v in ([1.0, 5.0], [3.0, 1.0]):
        m.embed("p", np.array(v))
        m.embed("q", np.array(v), pooling="max")
    assert m.embedding("p").tolist() == [2.0, 3.0] and m.embedding("q", "max").tolist() == [3.0, 5.0]
    m.embed("p", np.array([9.0, 9.0]), rewrite=True)
    assert m.embedding("p").tolist() == [9.0, 9.0]


def test_objects(spark):
    df = spark.createDataFrame([([7, 8], [0.9, 0.1, 0.4]), ([], [0.9])], "ids array<long>, s array<double>")
    assert [r.o for r in df.select(candidates.chosen_object("s", "ids").alias("o")).collect()] == [8, None]
    r = df.select(candidates.object_target("ids", F.lit("8"), F.lit(True)).alias("t"), candidates.object_target("ids", F.lit("8"), F.lit(False)).alias("u")).collect()
    assert [(x.t, x.u) for x in r] == [(2, -100), (-100, -100)]


def test_ngrams_work_their_tokens_out_once(spark):
    """The words of a text are not split anew for every window."""
    made = spark.range(1).select(A.ngrams(A.words(F.concat(F.lit("a b  c d "), F.col("id").cast("string"))), 3).alias("g"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert made.first().g == ["a b c", "b c d", "c d 0"]
    none = spark.createDataFrame([(None,), ("a b",)], "t string").select(A.ngrams(A.words("t"), 3).alias("g")).collect()
    assert [r.g for r in none] == [[], []]
