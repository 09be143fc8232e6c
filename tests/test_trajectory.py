"""Scores of trajectories on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from trailweave.operators import trajectory as T

DIST = "scan string, src string, dst string, d double"
LINE = {"a": 0.0, "b": 3.0, "c": 10.0, "d": 13.0, "e": 20.0}


@pytest.fixture(scope="module")
def dist(spark):
    return spark.createDataFrame([("s", x, y, abs(LINE[x] - LINE[y])) for x in LINE for y in LINE], DIST).cache()


def preds(spark, *rows):
    return spark.createDataFrame(list(rows), "instr_id string, trajectory array<array<string>>")


def gt(spark, *rows):
    return spark.createDataFrame(list(rows), "instr_id string, scan string, path array<string>")


def test_exact_detour_and_boundary(spark, dist):
    p = preds(spark, ("1", [["a"], ["b", "c"]]), ("2", [["a"], ["e"], ["c"]]), ("3", [["a"], ["d"]]), ("4", [["a"]]))
    g = gt(spark, ("1", "s", ["a", "c"]), ("2", "s", ["a", "c"]), ("3", "s", ["a", "c"]), ("4", "s", ["a", "a"]))
    r = {x.instr_id: x for x in T.score_to_goal(p, g, dist).collect()}
    assert (r["1"].success, r["1"].spl, r["1"].action_steps, r["1"].trajectory_steps) == (1, 1, 1, 2)
    assert r["2"].spl == pytest.approx(10 / 30) and r["2"].oracle_error == 0
    assert r["3"].nav_error == 3.0 and r["3"].success == 0  # the margin itself is too far
    assert (r["4"].success, r["4"].spl, r["4"].trajectory_lengths) == (1, 0, 0)
    s = T.summary(T.score_to_goal(p, g, dist)).first()
    assert s.sr == 75 and s.steps == pytest.approx(1.25)


def test_earlier_node_is_nearest(spark, dist):
    p = preds(spark, ("1", [["d"], ["a"], ["d"]])).withColumn("pred_path", F.flatten("trajectory")).withColumn("scan", F.lit("s")).withColumn("goal", F.lit("c"))
    assert T.walked(p, dist, "pred_path", "goal").first().nearest == "d"


@pytest.mark.parametrize(("row", "message"), [(("9", [["a"]]), "no ground truth"), (("1", [["b"]]), "wrong start")])
def test_constraints_raise(spark, dist, row, message):
    with pytest.raises(Exception, match=message):
        T.score_to_goal(preds(spark, row), gt(spark, ("1", "s", ["a", "c"])), dist).collect()


def test_unconnected_raises(spark, dist):
    with pytest.raises(Exception, match="not connected"):
        T.score_to_goal(preds(spark, ("1", [["a"], ["zz"]])), gt(spark, ("1", "s", ["a", "c"])), dist).collect()


def test_grounding_does_not_need_arrival(spark, dist):
    p = preds(spark, ("1", [["a"], ["e"]]), ("2", [["a"], ["b"]])).withColumn("pred_objid", F.when(F.col("instr_id") == "1", "7"))
    g = gt(spark, ("1", "s", ["a", "c"]), ("2", "s", ["a", "c"])).withColumn("goal_vps", F.array(F.lit("b"))).withColumn("objid", F.when(F.col("instr_id") == "1", 7))
    r = {x.instr_id: x for x in T.score_in_set(p, g, dist).collect()}
    assert (r["1"].success, r["1"].rgs) == (0, 1) and r["1"].rgspl == 0.5
    assert (r["2"].success, r["2"].rgs) == (1, 1)  # two absent ids are equal


def test_polygon(spark):
    square = [(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))]
    points = {(1.0, 1.0): True, (0.0, 1.0): False, (2.0, 2.0): False, (3.0, 1.0): False, (1.0, 0.0): False, (0.5, 1.9): True}
    df = spark.createDataFrame(list(points), "x double, y double")
    assert {(r.x, r.y): r.i for r in df.withColumn("i", T.inside_polygon(F.col("x"), F.col("y"), square)).collect()} == points


def test_retarget(spark):
    rows = spark.createDataFrame([("1", "s", ["a", "x"], ["e", "c"]), ("2", "s", ["a", "c"], ["c"])], "instr_id string, scan string, path array<string>, end_panos array<string>")
    paths = spark.createDataFrame([("s", "a", "e", ["a", "b", "e"]), ("s", "a", "c", ["a", "c"])], "scan string, src string, dst string, path array<string>")
    assert {r.instr_id: r.path for r in T.retargeted(rows, paths).collect()} == {"1": ["a", "c"], "2": ["a", "c"]}
