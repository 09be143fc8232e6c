"""Rule statistics against brute force; the forest on planted anomalies."""

import random
import re

import numpy as np
import pytest

from trailweave.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)]


CASES = [None, "", " \n\t", "one", "a b c d e f g h " * 3, "x\x85y z é #|", "l\nl\n\n \n l\nl\r\nl\r", "w " * 40]


@pytest.mark.parametrize("text", CASES + [" ".join(random.Random(s).choices("abc", k=90)) for s in range(6)])
def test_statistics(text):
    assert Q.rule_statistics(text)[0] == slow(text)


def rows(n, seed):
    rnd = random.Random(seed)
    for i in range(n):
        words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 8))) for _ in range(rnd.randint(25, 80))]
        bad = i % 9 == 0
        yield i, " ".join(w + rnd.choice(["###", "$$$"]) if bad else w for w in words), int(not bad)


def test_forest_separates(spark):
    data = list(rows(400, 1))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(1000, None, "x"), (1001, "", "x"), (5, data[5][1], "x")], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, g) for i, _, g in data] + [(3, None), (None, 1)], "doc_id long, quality int")
    forest = Q.fit(docs, labels)
    got = Q.quality_rules(docs, forest).collect()
    assert len(got) == 403
    kept = {r.doc_id: r.kept for r in got}
    assert not kept[1000] and not kept[1001]
    good = [kept[i] for i, _, g in data if g]
    bad = [kept[i] for i, _, g in data if not g]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.02
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "word " * 5), (2, " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.fit(docs, none) is None
    assert {r.doc_id: r.kept for r in Q.quality_rules(docs, None).collect()} == {1: False, 2: True}
    one = spark.createDataFrame([(2, 1)], "doc_id long, quality int")
    assert {r.doc_id: r.kept for r in Q.quality_rules(docs, Q.fit(docs, one)).collect()} == {1: False, 2: True}
    assert Q.quality_rules(docs.limit(0), None).count() == 0


def test_bounded_sample(spark):
    data = list(rows(300, 2))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in data], "doc_id long, quality int")
    forest = Q.fit(docs, labels, max_labelled=50)
    assert forest.sample <= 50


def test_path_lengths_against_plain_trees():
    """Every tree walked by recursion, row by row, and the score by its definition."""
    rng = np.random.default_rng(4)
    good = np.ones(400, bool)
    good[::10] = False
    x = rng.normal(size=(400, 5)) + np.where(good, 0, 8)[:, None]
    forest = Q.IsolationForest.fit(x, good, trees=20, sample=48)

    def mean_path(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def path(t, node, row, depth):
        if forest.axis[t, node] < 0:
            left = forest.path[t, node] - depth  # what the rows that a leaf still holds would take
            assert any(abs(left - mean_path(n)) < 1e-9 for n in range(1, 49))
            return depth + left
        return path(t, 2 * node + 1 + int(row[forest.axis[t, node]] >= forest.cut[t, node]), row, depth + 1)

    scaled = np.minimum(np.maximum(np.abs(x - forest.middle) / forest.spread - Q.SLACK, 0), Q.FAR)
    want = [2 ** (-np.mean([path(t, 0, row, 0) for t in range(20)]) / mean_path(48)) for row in scaled]
    assert forest.score(x) == pytest.approx(want)
    assert np.mean(forest.score(x)[~good]) > np.mean(forest.score(x)[good]) + 0.1


def test_scale_and_threshold_come_from_all_labelled_rows(spark):
    """Trees of 40 rows, but medians, deviations and the threshold of 600."""
    data = list(rows(600, 3))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, g) for i, _, g in data], "doc_id long, quality int")
    forest = Q.fit(docs, labels, max_labelled=40, max_clean_loss=0.02)
    x = np.array([Q.rule_statistics(t)[1] for _, t, g in data if g])
    assert forest.middle == pytest.approx(np.median(x, axis=0)) and forest.spread == pytest.approx(np.maximum(x.std(axis=0), Q.LEAST_SPREAD))
    assert forest.threshold == np.sort(forest.score(x))[::-1][int(len(x) * 0.02)]


def test_order_statistics(spark):
    rnd = random.Random(8)
    a, b = [rnd.choice([0.0, 1.0, rnd.random()]) for _ in range(999)], [rnd.gauss(0, 1) for _ in range(999)]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    places = [0, 1, 400, 499, 500, 997, 998]
    for p in places:
        assert Q.order_statistics(df, {"a": [p], "b": [0, p]}, 999) == {"a": [sorted(a)[p]], "b": [min(b), sorted(b)[p]]}
