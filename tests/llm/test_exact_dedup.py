"""Exact dedup against a plain grouping, with a weak hash as well."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trailweave.llm import exact_dedup as E

FIELDS = "doc_id long, text string, kept string"
ROWS = [
    (5, "a  b\n", "x"), (3, "a b ", "x"), (9, "a\x0bb\r\n", "x"), (4, "A b ", "x"), (7, None, "x"), (6, "", "x"), (8, " \t", "x"), (2, "  ", "x"),
    (1, "a b", "x"), (10, "é" * 100_000, "x"), (11, "é" * 100_000, "x"), (3, "a b ", "x"), (None, "null id", "x"), (12, "null  id", "x"), (None, "alone", "x"),
]


def slow(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[norm(t)].append(i)
    out, seen = [], set()
    for i, t, _ in rows:
        again = (i, norm(t)) in seen
        seen.add((i, norm(t)))
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[norm(t)]), i == keep and not again, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hash_of", [E.content_hash, lambda t: F.substring(F.unhex(F.md5(t)), 1, 0), lambda t: (F.length(t) % 2).cast("string").cast("binary")])
def test_groups(spark, hash_of):
    got = E.exact_dedup(spark.createDataFrame(ROWS, FIELDS), hash_of=hash_of).collect()
    assert sorted(map(tuple, got), key=str) == slow(ROWS)


def test_groups_beyond_the_broadcast_ones(spark, monkeypatch):
    monkeypatch.setattr(E, "HOT_GROUPS", 1)
    assert sorted(map(tuple, E.exact_dedup(spark.createDataFrame(ROWS * 2, FIELDS)).collect()), key=str) == slow(ROWS * 2)


def test_two_texts_of_one_name_raise(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], FIELDS)
    monkeypatch.setattr(E.F, "xxhash64", lambda *_: F.lit(0).cast("long"))
    with pytest.raises(Exception, match="share both content hashes"):
        E.exact_dedup(rows, hash_of=lambda t: F.lit(b"")).collect()


def test_empty(spark):
    assert E.exact_dedup(spark.createDataFrame([], FIELDS)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = E.exact_dedup(spark.createDataFrame([(1, "a", "x")], FIELDS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
