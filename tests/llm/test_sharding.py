"""The permutation-filled table and placement by it."""

import hashlib
from collections import Counter

import pytest

from trailweave.llm import sharding as S

NAMES = [f"s{k}" for k in range(7)]


def slow_table(shards, size):
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    orders = [[(number(f"start:{s}") + j * (number(f"stride:{s}") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    owner = {}
    while len(owner) < size:
        for k, order in enumerate(orders):
            if len(owner) < size:
                owner[next(x for x in order if x not in owner)] = k
    return [owner[x] for x in range(size)]


@pytest.mark.parametrize("size", [7, 13, 101, 257])
def test_table(size):
    assert S.lookup_table(NAMES, size) == slow_table(NAMES, size)


def test_even_and_stable():
    table = S.lookup_table(NAMES, 5003)
    shares = Counter(table)
    assert max(shares.values()) - min(shares.values()) <= 1
    fewer = S.lookup_table(NAMES[:-1], 5003)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.15 * 5003  # beside the lost shard's own slots few change hands


@pytest.mark.parametrize(("shards", "size"), [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)])
def test_bad_tables(shards, size):
    with pytest.raises(ValueError):
        S.lookup_table(shards, size)


def test_placement(spark, tmp_path):
    rows = [(k, f"src{k % 3}", "old") for k in range(200)] + [(None, None, "old"), (None, "", "old"), (5, "src2", "old")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, shard string")
    placed = S.assign_shards(docs, ["doc_id", "source"], NAMES, 101)
    got = placed.collect()
    table = S.lookup_table(NAMES, 101)
    assert len(got) == len(rows)
    for r in got:
        parts = ["n" if x is None else f"v{x}" for x in (r.doc_id, r.source)]
        slot = int(hashlib.md5("\x1f".join(parts).encode()).hexdigest()[:15], 16) % 101
        assert (r.slot, r.shard, r.shard_name) == (slot, table[slot], NAMES[table[slot]])
    assert len({r.slot for r in got if r.doc_id is None}) == 2  # null and empty are different keys
    S.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == len({r.shard for r in got})
    assert S.assign_shards(docs.limit(0), ["doc_id"], NAMES, 101).count() == 0
