"""SimHash fingerprints and components against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import types as T

from trailweave.llm import simhash

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("fp", T.StringType())])


def slow_fingerprint(text, k=3):
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, d):
    label = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, fps):
            for j, b in zip(ids, fps):
                if (a ^ b).bit_count() <= d and label[j] > label[i]:
                    label[j], changed = label[i], True
    return label


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "ÀB cÉ d\x0be f", "a b c d e " * 50, "x y z\x85w q"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_spans_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    text = " ".join(f"w{i % 13}" for i in range(100))
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("d", [1, 2, 3])
def test_links_match_brute_force(spark, d):
    rnd = random.Random(d)
    values = {rnd.getrandbits(64) for _ in range(40)}
    for v in list(values):
        for _ in range(6):
            values.add(v ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4))))
    values |= {0, (1 << 64) - 1, 1, 1 << 63}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {tuple(sorted(r)) for r in simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), d).collect()}
    full = (1 << 64) - 1
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a ^ b) & full).bit_count() <= d}
    assert got == want


def test_components(spark):
    rnd = random.Random(5)
    base = [[f"w{rnd.randrange(500)}" for _ in range(120)] for _ in range(12)]
    texts = [None, "", " ", "One", "one"]
    for words in base:
        for n in range(6):
            copy = list(words)
            for _ in range(n // 2):
                copy[rnd.randrange(len(copy))] = "new"
            texts.append(" ".join(copy))
    ids = rnd.sample(range(1000), len(texts))
    rows = [(i, t, "clash") for i, t in zip(ids, texts)]
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.simhash_groups(spark.createDataFrame(rows + [rows[-1]], SCHEMA)).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    want = slow_components(ids, fps, 2)
    assert {i: (f - (1 << 64) if f >> 63 else f, want[i]) for i, f in zip(ids, fps)} == got


def test_empty_and_null_ids(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    got = simhash.simhash_groups(spark.createDataFrame([(None, "a b c", ""), (None, "x", ""), (4, "a b  C", "")], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == [(4, 4), (None, 4), (None, None)]


def test_near_dedup_keeps_one(spark):
    rows = [(3, "a b c d", "k"), (1, "a b  c d", "l"), (2, "other words are here", "m")]
    rows += [(None, "a b c d", "n"), (3, "some text of its own", "o"), (5, "a b c  d", "p")]
    kept = simhash.near_dedup(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert sorted((str(r.doc_id), r.fp) for r in kept.collect()) == [("1", "l"), ("2", "m"), ("3", "k"), ("3", "o"), ("None", "n")]


def test_groups_beyond_the_broadcast_ones(spark, monkeypatch):
    rows = [(k, t, "") for k, t in enumerate(["a b c d"] * 5 + [""] * 4 + [None] * 3 + ["one two three"] * 2 + ["alone in here"])]
    want = sorted(map(tuple, simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()))
    for hot in (0, 1):
        monkeypatch.setattr(simhash, "HOT", hot)
        assert sorted(map(tuple, simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect())) == want
    assert [w[2] for w in want] == [0] * 5 + [5] * 7 + [12] * 2 + [14]
