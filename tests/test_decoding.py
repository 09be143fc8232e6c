"""Constrained decoding against all lists of a vocabulary."""

import pytest
from pyspark.sql import functions as F

from trailweave.operators import decoding, memory

WORDS = [[1, 2, 3], [1, 2], [1, 4], [2], [2, 2, 2, 2], [3, 1], [5, 1, 1]]


def cost(i, step, token):
    return -((i * 7 + step * 5 + token * 11) % 17) / 4


def scored(each):
    return each.withColumn("score", -(((F.col("id") * 7 + F.col("step") * 5 + F.col("token") * 11) % 17) / 4))


def all_lists(i):
    """Lists that end: those that go on have no end of their own."""
    said = [w for w in WORDS if not any(v != w and v[: len(w)] == w for v in WORDS)]
    out = [(sum(cost(i, k, t) for k, t in enumerate([*w, 0])), w) for w in said]
    return sorted(out, key=lambda x: (-x[0], x[1]))


@pytest.fixture
def table(spark):
    return memory.prefix_table(spark.createDataFrame([(w,) for w in WORDS], "ids array<long>"), "ids", 0)


def test_wide_beams_find_the_best_lists(spark, table):
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(40)], "id long, name string")
    got = decoding.decoded(rows, table, scored, 0, beams=8, cut=2).collect()
    assert {r.name for r in got} == {f"r{i}" for i in range(40)} and all(r.ended for r in got)
    for i in range(40):
        mine = sorted((r.rank, r.total, r.tokens) for r in got if r.id == i)
        assert [(t, w) for _, t, w in mine] == [(pytest.approx(t), w) for t, w in all_lists(i)][: len(mine)] and len(mine) == 5


def test_greedy_takes_the_best_step(spark, table):
    rows = spark.createDataFrame([(i,) for i in range(30)], "id long")
    for r in decoding.decoded(rows, table, scored, 0).collect():
        said, total = [], 0.0
        while True:
            may = sorted({w[len(said)] for w in WORDS if len(w) > len(said) and w[: len(said)] == said}) or [0]
            best = max(may, key=lambda t: (cost(r.id, len(said), t), -t))
            total += cost(r.id, len(said), best)
            if best == 0:
                break
            said.append(best)
        assert (r.tokens, r.total, r.rank) == (said, pytest.approx(total), 1)


def test_limits(spark, table):
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    short = decoding.decoded(rows, table, scored, 0, beams=2, most_tokens=1).collect()
    assert all(len(r.tokens) == 1 and not r.ended for r in short) and len(short) == 4
    none = decoding.decoded(rows, table.limit(0), scored, 0).collect()
    assert [(r.tokens, r.total) for r in none] == [([], 0.0)] * 2
    assert not decoding.decoded(rows.limit(0), table, scored, 0).count()
