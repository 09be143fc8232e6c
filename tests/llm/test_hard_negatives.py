"""Hard negatives against a plain search, with ties, repeated ids, nulls and vectors of several lengths."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from trailweave.llm import hard_negatives as H
from trailweave.llm import queries as Q

FIELDS = "vec_id long, embedding array<float>, label int"


def slow(rows, every=100):
    good = []
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * float(np.float32(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (i, y, v) in enumerate(good):
        if i % every:
            continue
        scores = [(-dot(v, w), j, z) for n, (j, z, w) in enumerate(good) if n != k]
        for p, pid, _ in sorted(s for s in scores if s[2] == y)[:5]:
            fit = sorted((s, j) for s, j, z in scores if z != y and 30 * -p <= 100 * -s <= 90 * -p)[:10]
            out += [(i, pid, r, j, -p, -s) for r, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, FIELDS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    clash = (F.lit("clash").alias(c) for c in ("id", "own", "is_anchor", "planes", "near", "uid", "bucket", "score", "rank", "low", "high", "window"))
    vectors = df.select("vec_id", label.alias("label"), H.scaled("embedding", 256).alias("vector"), *clash)
    return sorted(map(tuple, H.hard_negatives(vectors, F.col("vec_id") % 100 == 0, **more).collect()))


def drawn(seed, n, width, labels, grain):
    rng = random.Random(seed)
    return [(rng.randrange(n) * 20, [round(rng.gauss(0.1, 0.3) * grain) / grain for _ in range(width)], rng.randrange(labels)) for _ in range(n)]


@pytest.mark.parametrize(("seed", "n", "width", "labels", "grain", "bucket"), [(1, 300, 8, 3, 4, 50), (2, 200, 64, 10, 1000, 200_000), (3, 150, 3, 2, 2, 7), (4, 60, 65, 1, 50, 20), (5, 40, 1, 30, 8, 5)])
def test_same_as_plain(spark, monkeypatch, seed, n, width, labels, grain, bucket):
    monkeypatch.setattr(H, "ROWS", 37)
    monkeypatch.setattr(H, "ANCHORS", 3)
    rows = drawn(seed, n, width, labels, grain)
    want = slow(rows)
    assert mined(spark, rows, bucket_rows=bucket) == want
    assert len(want) > 20 or labels in (1, 30)


def test_what_takes_no_part(spark):
    rows = drawn(8, 200, 4, 3, 10)
    rows += [(100, None, 1), (200, [0.5, None, 0.1, 0.1], 1), (300, [float("nan"), 0.1, 0.1, 0.1], 1), (400, [float("inf"), 0.1, 0.1, 0.1], 2), (500, [0.4] * 4, None), (None, [0.9] * 4, 1)]
    rows += [(600, [], 1), (700, [0.3, 0.2], 2), (700, [0.3, 0.2], 2), (800, [0.0] * 4, 1), (0, [0.5] * 4, 1), (0, [0.5] * 4, 1)]
    assert mined(spark, rows) == slow(rows)
    assert mined(spark, rows[:0]) == []
    with pytest.raises(ValueError, match="could pass"):
        mined(spark, [(0, [1e9], 1)])


def test_sql_takes_the_same_rows(spark, tmp_path):
    rows = [*drawn(9, 150, 6, 10, 8), (100, None, 1), (100, [0.5, None], 1), (300, [float("nan")], 1), (None, [0.1], 1), (500, [0.1], None), (600, [], 4)]
    spark.createDataFrame(rows, FIELDS).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = Q.op11_hard_negatives(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({Q.HARD_NEGATIVES_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) == slow(rows)


def test_planes():
    shape = H.Planes(11, 9)
    values = np.random.default_rng(1).integers(-256, 256, (40, 11))
    assert (shape.values(shape.pack(values)) == values).all()


def test_rows_are_dropped_before_the_last_plane():
    """Of random vectors few are taken to their last plane, and none of the best is dropped."""
    rng = np.random.default_rng(2)
    shape = H.Planes(64, 9)
    anchors, rows = (np.floor(rng.normal(0, 32, (n, 64))).clip(-256, 255) for n in (5, 2000))
    planes = [p.astype(float) for p in shape.unpack(shape.pack(rows.astype(np.int64)))]
    low, high = np.full((5, 1), -np.inf), np.full((5, 1), np.inf)
    a, r, s = H.kept_pairs(anchors, planes, shape.weights(), low, high, low, 6, None)
    want = anchors @ rows.T
    assert (s == want[a, r]).all() and len(a) < 0.02 * want.size
    for k in range(5):
        assert set(np.argsort(-want[k])[:6]) <= set(r[a == k])
