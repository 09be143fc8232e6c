"""The trie against a plain one, over tasks of few rows, so that nodes reach over borders."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from trailweave.llm import prefix_trie as T
from trailweave.llm import queries as Q

FIELDS = "conv_id long, turn long, role string, text string"


def slow_rebuilt(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = turns.get(family, [])[:h] + own[h:]
    return out


def slow(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for key, ids in members.items():
        below = [k for k in members if k[: len(key)] == key]
        childless = [k for k in below if not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in below)]
        ends = sorted(c for c in ids if len(convs[c]) == len(key))
        saved = sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k)
        up = min(members[key[:-1]]) if key else None
        out.append((min(ids), len(key), up, len(ids), sum(len(k) == len(key) + 1 for k in below), len(childless), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def drawn(seed, convs, most, words):
    rng = random.Random(seed)
    texts = ["".join(rng.choices("aé\U0001f600", k=k)) for k in range(words)]
    rows = []
    for c in rng.sample(range(-250, 900), convs):
        rows += [(c, t, rng.choice("ua"), rng.choice(texts)) for t in range(rng.randrange(1, most))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "convs", "most", "words", "partitions"), [(1, 60, 5, 1, 9), (2, 40, 9, 2, 40), (3, 80, 3, 2, 5), (4, 30, 12, 1, 30), (5, 50, 4, 3, 1), (6, 200, 2, 1, 20)])
def test_same_as_plain(spark, monkeypatch, seed, convs, most, words, partitions):
    monkeypatch.setattr(T, "PIECE", 3)
    rows = drawn(seed, convs, most, words)
    got = T.prefix_trie(T.rebuilt(spark.createDataFrame(rows, FIELDS)), partitions).collect()
    assert sorted(map(tuple, got), key=str) == slow(slow_rebuilt(rows))


def test_equal_conversations_over_many_tasks(spark):
    rows = [(c, t, "u", "same") for c in range(300) for t in range(7)] + [(1000, 0, "u", None), (1000, 0, None, "x"), (None, 0, "u", "y"), (1001, None, "u", "z"), (1001, 1, "u", "same"), (1001, 1, "u", "same")]
    df = spark.createDataFrame(rows, FIELDS).select("*", *(F.lit("clash").alias(c) for c in ("pos", "digest", "chars", "turns", "begin", "depth", "task", "key", "family", "head", "at")))
    got = T.prefix_trie(T.rebuilt(df), 17).collect()
    assert sorted(map(tuple, got), key=str) == slow(slow_rebuilt(rows))
    assert not T.prefix_trie(T.rebuilt(df.limit(0))).count()


def test_long_conversation_and_text(spark):
    rows = [(0, t, "u", f"turn {t}") for t in range(3000)] + [(1, t, "u", f"turn {t}") for t in range(2500)] + [(200, 0, "u", "y" * 3_000_000)]
    got = {(r.conv_id, r.depth): r for r in T.prefix_trie(T.rebuilt(spark.createDataFrame(rows, FIELDS)), 3).collect()}
    assert len(got) == 3002 and got[0, 2500].n_convs == 2 and got[0, 2501].n_convs == 1 and got[0, 0].n_leaves == 2


def test_sql_takes_the_same_rows(spark, tmp_path):
    rows = drawn(7, 50, 6, 2) + [(3, None, None, None), (3, 0, "u", "q"), (None, 1, "u", "r")]
    spark.createDataFrame(rows, FIELDS).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = Q.op12_prefix_trie(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({Q.PREFIX_TRIE_SQL})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) == slow(slow_rebuilt(rows))


def test_shared_turns():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice((b"x" * T.WIDTH, b"y" * T.WIDTH)) for _ in range(rng.randrange(9))] for _ in "ab")
        b = a[: rng.randrange(len(a) + 1)] + b
        want = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert T.shared_turns(b"".join(a), b"".join(b)) == want
