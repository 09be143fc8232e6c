"""The classifier: held-out accuracy, updates against a plain version, defined cases."""

import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from trailweave.llm import queries
from trailweave.llm import quality_classifier as C

SF = "/root/testdata/sf0.1"
FIELDS = "doc_id long, text string"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the benchmark tables are not here")
def test_held_out_documents_are_told_apart(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL")
    found = queries.op13_quality_classifier(spark, SF).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    good, bad = (found[found.quality == q].score.to_numpy() for q in (1, 0))
    assert len(good) > 1000 and len(bad) > 150
    assert (good[:, None] > bad[None, :]).mean() > 0.999
    assert (found.predicted == found.quality).mean() > 0.99
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.5)).all()


def test_updates_are_those_of_the_rule():
    """Coordinate by coordinate, with dictionaries."""
    rng = np.random.default_rng(3)
    model, z, n = C.Ftrl(), {}, {}
    for _ in range(200):
        at = rng.choice(50, 7, replace=False)
        x, y = rng.uniform(0.1, 1, 7), float(rng.integers(2))
        w = {}
        for i in at:
            zi, ni = z.get(i, 0.0), n.get(i, 0.0)
            w[i] = 0.0 if abs(zi) <= model.l1 else (math.copysign(model.l1, zi) - zi) / ((model.beta + math.sqrt(ni)) / model.alpha + model.l2)
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, x))))
        for i, v in zip(at, x):
            g = (p - y) * v
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / model.alpha
            z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
        assert model.learn(at, x, y) == pytest.approx(p)
    assert {int(i): pytest.approx(v) for i, v in z.items()} == {int(i): model.z[i] for i in z}


def test_features():
    """The whole text counts, to its last word; repetition is told from other pairs."""
    head = " ".join(f"w{k}" for k in range(50_000))
    a, b = C.ngram_features(head + " end"), C.ngram_features(head + " other")
    assert not np.array_equal(a[0], b[0])
    at, x = C.ngram_features("ab ab ab ### cd")
    assert len(at) == 7 and float(x @ x) == pytest.approx(1)  # 3 words, the repeated pair, ab ###, ### cd, two places on
    assert [len(v) for v in C.ngram_features(None)] == [0, 0] == [len(v) for v in C.ngram_features(" \n")]


def test_learning_takes_no_held_out_labels(spark):
    ids = range(60)
    docs = spark.createDataFrame([(i, f"good words here number{i}" if i % 2 else f"BAD!! WORDS!! number{i}") for i in ids], FIELDS)
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(C.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert any(zlib.crc32(str(i).encode()) % 3 == 1 for i in ids)
    assert np.array_equal(C.fit(docs, labels), C.fit(docs, turned)) and C.fit(docs, labels).any()


def test_defined_cases(spark):
    rows = [(1, "good words here and more"), (1, "good words here and more"), (2, "BAD!! WORDS!!"), (None, "good words here"), (3, None), (4, ""), (5, " \n"), (6, "BAD!! " * 200_000), (8, "é" * 500)]
    df = spark.createDataFrame(rows, FIELDS).select("*", *(F.lit("clash").alias(c) for c in ("score", "predicted", "l", "i", "t", "good", "at", "x", "f", "_text", "held_out")))
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (8, None)], "doc_id long, quality int").withColumn("good", F.lit("clash"))
    weights = C.fit(df, labels)
    got = sorted(((r.doc_id, r.score, r.predicted) for r in C.scored(df, weights).collect()), key=str)
    assert [g[0] for g in got] == [1, 1, 2, 3, 4, 5, 6, 8, None]
    by = {g[0]: g[1] for g in got}
    assert by[3] == by[4] == by[5] and 0 <= by[3] <= 1 and by[2] < by[1]
    assert not C.scored(df.limit(0), C.fit(df.limit(0), labels)).count()
    assert {r.score for r in C.scored(df, C.fit(df, labels.limit(0))).collect()} == {0.5}
