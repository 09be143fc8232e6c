"""Page files, records and matrix stores: round trips, ranges, look-ups, tasks that fail and are tried again."""

import os
import random
import subprocess
import sys
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.sources import catalog
from trailweave.sources import matrixstore as M
from trailweave.sources import pagefile as P
from trailweave.sources.records import packed, unpacked

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_records():
    values = [None, True, False, 0, 127, 128, -1, -32, -33, 2**40, -(2**40), 2**63 + 5, 1.5, "", "é" * 40, "x" * 70_000, b"", b"\0" * 300, [], list(range(20)), {}, {"a": [1, {"b": None}]}, {str(k): k for k in range(40)}]
    for v in values:
        assert unpacked(packed(v)) == v
    assert unpacked(packed(values)) == values
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    assert unpacked(packed({"fts": a, "n": np.int64(3)})) == {"fts": a.tolist(), "n": 3}
    # as other writers put them: keys as bytes, small and wide forms
    assert unpacked(b"\x81\xc4\x01a\xca\x3f\x80\x00\x00") == {"a": 1.0} and unpacked(b"\xdc\x00\x02\xcd\x01\x00\xd0\xff") == [256, -1]
    for bad in (b"", b"\x81", b"\xa5ab", b"\x01\x01", b"\xc1", b"\xcd\x01"):
        with pytest.raises(ValueError):
            unpacked(bad)


@pytest.mark.parametrize(("n", "most"), [(0, 10), (1, 10), (50, 9000), (3000, 60), (40_000, 3)])
def test_files_of_all_depths(spark, tmp_path, n, most):
    rng = random.Random(n)
    want = {f"k{rng.randrange(10**9):09d}": rng.randbytes(rng.randrange(most)) for _ in range(n)}
    P._load(((k.encode(), v) for k, v in sorted(want.items())), f"{tmp_path}/data.mdb")
    got = {r.key: bytes(r.value) for r in P.read(spark, str(tmp_path), tasks="7").collect()}
    assert got == want and P.PageFile(f"{tmp_path}/data.mdb").entries == len(want)
    if not n:
        return
    names = sorted(want)
    for a, b in ((names[n // 3], names[n // 2]), ("a", "k5"), (names[-1], "z"), ("x", "y")):
        assert {r.key for r in P.read(spark, f"{tmp_path}/data.mdb", from_=a, until=b).collect()} == {k for k in names if a <= k < b}
    some = [*names[:: max(1, n // 5)], "absent", "k", names[-1] + "0"]
    assert {r.key: bytes(r.value) for r in P.read(spark, str(tmp_path), keys=some).collect()} == {k: want[k] for k in some if k in want}
    assert not P.read(spark, str(tmp_path), keys=[]).count()


def test_few_pages_are_read_for_a_key(tmp_path, monkeypatch):
    P._load(((f"k{k:06d}".encode(), b"v" * 20) for k in range(50_000)), f"{tmp_path}/data.mdb")
    read = []
    seen = P.PageFile.nodes
    monkeypatch.setattr(P.PageFile, "nodes", lambda self, number: read.append(number) or seen(self, number))
    reader = P.PageReader(P.StructType.fromDDL("key string, value binary"), {"path": str(tmp_path), "keys": '["k031234"]'})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["key"] for r in rows] == ["k031234"] and len(read) <= 8


def test_the_later_head_counts_and_others_are_no_store(tmp_path):
    P._load(iter([(b"a", b"1")]), f"{tmp_path}/data.mdb")
    with open(f"{tmp_path}/data.mdb", "r+b") as f:  # an older head, of an empty tree
        at = P.PAGE_HEAD.size + P.HEAD.size + 2 * P.TREE.size - 8
        f.seek(at)
        f.write((2**64 - 1).to_bytes(8, "little"))
    assert [k for k, _ in P.PageFile(f"{tmp_path}/data.mdb").entries_of(P.PageFile(f"{tmp_path}/data.mdb").root, None, None)] == [b"a"]
    (tmp_path / "other").write_bytes(b"x" * 9000)
    with pytest.raises(ValueError, match="not a page file"):
        P.PageFile(f"{tmp_path}/other")
    for rows in ([(b"b", b""), (b"a", b"")], [(b"", b"")], [(b"k" * 512, b"")], [(b"a", b""), (b"a", b"")]):
        with pytest.raises(ValueError):
            P._load(iter(rows), f"{tmp_path}/bad")


def test_folders_of_records(spark, tmp_path):
    df = spark.range(2000).select(F.format_string("s%d_%05d", F.col("id") % 3, F.col("id")).alias("key"), F.array(F.array(F.col("id").cast("double"), F.lit(None).cast("double"))).alias("fts"), F.when(F.col("id") % 2 == 0, F.struct(F.lit("x").alias("a"))).alias("s"))
    P.written(df.repartition(5), f"{tmp_path}/store", 4)
    form = "key string, fts array<array<double>>, s struct<a: string>, absent array<long>"
    got = {r.key: r for r in P.read(spark, f"{tmp_path}/store", form).collect()}
    assert len(got) == 2000 and got["s1_00001"].fts == [[1.0, None]] and got["s0_00000"].s.a == "x" and got["s1_00001"].s is None and got["s1_00001"].absent is None
    assert {r.key for r in P.read(spark, f"{tmp_path}/store", form, from_="s1_", until="s1`").collect()} == {k for k in got if k.startswith("s1_")}
    assert len([f for f in os.listdir(f"{tmp_path}/store") if f.endswith(".mdb")]) >= 2
    P.written(df.limit(0), f"{tmp_path}/empty")
    assert not P.read(spark, f"{tmp_path}/empty").count()


def test_matrices(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"k{k}", k, [[rng.randrange(1000) / 8 for _ in range(k % 11)] for _ in range(k % 4)]) for k in range(60)]
    M.written(spark.createDataFrame(rows, "name string, place int, m array<array<double>>"), f"{tmp_path}/m", "name", "m", columns=10, block=3)
    for first in (None, 1, 3, 4, 10, 50):
        got = {r.key: (r.place, r.matrix) for r in M.read(spark, f"{tmp_path}/m", first).collect()}
        assert got == {name: (place, [r[:first] for r in m]) for name, place, m in rows}
    plan = M.read(spark, f"{tmp_path}/m", 4)._jdf.queryExecution().executedPlan().toString()
    assert "c0001" in plan and "c0002" not in plan and "c0003" not in plan
    assert not M.read(spark, f"{tmp_path}/m").limit(0).count()
    for bad in ([[1.0], [1.0, 2.0]], [[1.0] * 11]):
        with pytest.raises(Exception, match="uneven or too wide"):
            M.written(spark.createDataFrame([("k", 1, bad)], "name string, place int, m array<array<double>>"), f"{tmp_path}/bad{len(bad)}", "name", "m", columns=10)


FAILS = """
    import os, sys
    from pyspark.sql import SparkSession, functions as F
    from pyspark import TaskContext
    from trailweave.sources import matrixstore, pagefile
    spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    at = sys.argv[1]

    def run(batches):
        for b in batches:
            yield b
        if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
            raise RuntimeError("lost")

    df = spark.range(900).select(F.format_string("k%04d", "id").alias("key"), F.array(F.array(F.col("id").cast("double"))).alias("m"))
    late = lambda d: d.repartitionByRange(3, "key").sortWithinPartitions("key").mapInArrow(run, d.schema)
    matrixstore.written(late(df), at + "/m", "key", "m", 1)
    spark.dataSource.register(pagefile.PageSource)
    late(df).write.format("pagefile").mode("append").save(at + "/p")
    a = {r.key: r.matrix[0][0] for r in matrixstore.read(spark, at + "/m").collect()}
    b = {r.key: r.m[0][0] for r in pagefile.read(spark, at + "/p", "key string, m array<array<double>>").collect()}
    assert a == b == {"k%04d" % k: float(k) for k in range(900)}
    assert pagefile.read(spark, at + "/p").count() == 900
    print("whole")
"""


def test_tasks_that_fail_are_tried_again(tmp_path):
    env = os.environ | {"PYTHONPATH": ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(FAILS), str(tmp_path)], env=env, capture_output=True, text=True, timeout=240)
    assert done.stdout.strip().endswith("whole"), done.stderr[-2000:]


def test_stores_by_their_endings(spark, tmp_path):
    rows = spark.createDataFrame([("a", [[1.0, 2.0, 3.0]]), ("b", [])], "key string, m array<array<double>>")
    M.written(rows, f"{tmp_path}/f.matrix", "key", "m", 3)
    P.written(rows.where("key = 'a'"), f"{tmp_path}/o.pages")
    rows.write.parquet(f"{tmp_path}/plain")
    stores = catalog.Catalog(spark, {"f": "f.matrix", "o": "o.pages", "p": f"{tmp_path}/plain"}, str(tmp_path), catalog.store_of(2, "key string, m array<array<double>>"))
    assert {r.key: r.matrix for r in stores.store("f").collect()} == {"a": [[1.0, 2.0]], "b": []}
    assert [(r.key, r.m) for r in stores.store("o").collect()] == [("a", [[1.0, 2.0, 3.0]])] and stores.store("p").count() == 2
    assert stores.store("f") is stores.store("f")
