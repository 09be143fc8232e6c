"""Near copies against the similarity of all pairs."""

import random

import corpus_pipeline as P
import numpy as np
from trailweave.llm import jaccard

FIELDS = "doc_id long, text string, extra string"


def slow_groups(rows):
    sets = [frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for _, t, _ in rows]
    label, pairs = list(range(len(rows))), 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or a | b and 5 * len(a & b) >= 4 * len(a | b):
                pairs += a != b
                label = [label[i] if x == label[j] else x for x in label]
    least = {}
    for x, (i, _, _) in zip(label, rows):
        least[x] = min(least.get(x, i), i)
    return {i: least[x] for x, (i, _, _) in zip(label, rows)}, pairs


def planted(seed, bases=20, copies=6):
    """Texts with copies that have a share of words changed, so that similarities lie on both sides of 0.8."""
    rnd = random.Random(seed)
    texts = [None, "", " ", "One", "one", "a b c d e", "a b c d e f"]
    for _ in range(bases):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(60, 400))]
        texts.append(" ".join(words))
        for _ in range(copies):
            words = list(words) if rnd.random() < 0.5 else texts[-1].split()
            for _ in range(rnd.randint(1, max(1, len(words) // 30))):
                words[rnd.randrange(len(words))] = f"new{rnd.random()}"
            texts.append(" ".join(words))
    return [(i, t, "x") for i, t in zip(rnd.sample(range(10000), len(texts)), texts)]


def test_groups_match_brute_force(spark):
    rows = planted(3)
    want, pairs = slow_groups(rows)
    got = {r.doc_id: r.component_id for r in jaccard.near_copy_groups(spark.createDataFrame(rows, FIELDS)).collect()}
    assert pairs > 50 and len(set(want.values())) > 25
    assert got == want


def test_pipeline_stage_takes_near_copies(spark):
    rows = planted(4)
    want, _ = slow_groups(rows)
    kept = P.near_copies(spark, spark.createDataFrame(rows, FIELDS), "")
    assert kept.columns == ["doc_id", "text", "extra"] and {r.doc_id for r in kept.collect()} == {i for i, g in want.items() if i == g}


def test_recall_of_keys_at_the_border():
    rnd, met, n = np.random.default_rng(1), 0, 400
    for _ in range(n):
        pool = rnd.integers(0, 1 << 64, 300, dtype=np.uint64)
        a, b = np.sort(pool[:270]), np.sort(pool[30:])  # 240 of 300 shared
        met += jaccard.alike(a, b) and bool(set(jaccard.band_keys(a)) & set(jaccard.band_keys(b)))
    assert met >= n - 1


def test_bucket_whose_least_is_not_alike(spark, monkeypatch):
    """All texts share a bucket: pairs that the least node is no part of are found too."""
    monkeypatch.setattr(jaccard, "band_keys", lambda found: np.zeros(min(1, len(found)), np.int64))
    rows = planted(5, bases=6, copies=3)
    got = {r.doc_id: r.component_id for r in jaccard.near_copy_groups(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == slow_groups(rows)[0]


def test_null_and_repeated_ids(spark):
    assert jaccard.near_dedup(spark.createDataFrame([], FIELDS)).count() == 0
    rows = [(3, "a b c d", "k"), (1, "a b  c d", "l"), (2, "other words are here", "m")]
    rows += [(None, "a b c d", "n"), (3, "some text of its own", "o"), (5, "a b c  d", "p")]
    kept = jaccard.near_dedup(spark.createDataFrame(rows, FIELDS))
    assert sorted((str(r.doc_id), r.extra) for r in kept.collect()) == [("1", "l"), ("2", "m"), ("3", "k"), ("3", "o"), ("None", "n")]
