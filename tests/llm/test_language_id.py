"""Language identification: held-out accuracy, and what must not be learned from."""

import random
import zlib

import numpy as np
import pytest

from trailweave.llm import language_id as L

SOUNDS = {"aa": "ka ro mi ta lu".split(), "bb": "sch ung ter ein ver".split(), "cc": "oux eau ré ien ill".split()}
FIELDS = "doc_id long, text string, lang string, score string"


def text(lang, rnd, n):
    return " ".join("".join(rnd.choices(SOUNDS[lang], k=rnd.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    return [(i, text(lang, rnd, rnd.randint(4, 60)), lang, "x") for i in range(240) for lang in [rnd.choice(sorted(SOUNDS))]]


def test_held_out_accuracy(spark, rows):
    docs = spark.createDataFrame(rows, FIELDS)
    model = L.fit(docs)
    assert model.languages == ["aa", "bb", "cc"]
    assert 0 < model.rejected_below <= 1
    got = L.predict(docs, model).withColumn("held_out", L.held_out()).collect()
    truth = {r[0]: r[2] for r in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    apart = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in apart) / len(apart) > 0.97
    assert all(0 < r.score <= 1 for r in got)


def plain_buckets(word):
    """The buckets of a word, by loops."""
    raw = f"<{word}>".encode()
    out = [zlib.crc32(raw) % L.BUCKETS]
    for n in (2, 3, 4):
        for k in range(len(raw) - n + 1):
            code = int.from_bytes(raw[k : k + n], "little")
            out.append((((code + n) * 0x9E3779B97F4A7C15) % 2**64 >> 40) % L.BUCKETS)
    return out


def test_predictions_against_a_plain_mean_of_embeddings():
    rng = np.random.default_rng(5)
    embed, layer, bias = rng.normal(size=(L.BUCKETS, L.DIMENSIONS)), rng.normal(size=(3, L.DIMENSIONS)), rng.normal(size=3)
    model = L.folded(["p", "q", "r"], embed, layer, bias)
    model.temperature = 0.7
    rnd = random.Random(6)
    texts = ["a", "Ärger über Öl", "x" * 130 + " y", "1 2 drei", *(text(rnd.choice(sorted(SOUNDS)), rnd, rnd.randint(1, 90)) for _ in range(60))]
    for t in texts:
        words = [w[k : k + 40] for w in t.lower().split() for k in range(0, len(w), 40)]
        mean = np.mean([embed[b] for w in words for b in plain_buckets(w)], axis=0)
        z = (layer @ mean + bias) / 0.7
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        lang, score, _ = L.Predictor(model).predict(t)
        assert lang == "pqr"[p.argmax()] and score == pytest.approx(p.max(), rel=1e-6)


def test_a_step_goes_down_the_gradient():
    rng = np.random.default_rng(7)
    bags = [(ids, (np.arange(1, len(ids) + 1) / np.arange(1, len(ids) + 1).sum()).astype(np.float32)) for ids in (np.array([1, 4, 9]), np.array([4]), np.array([2, 9, 11, 30]))]
    y = np.array([0, 1, 1])
    embed, layer, bias = (rng.normal(size=s).astype(np.float32) for s in ((40, L.DIMENSIONS), (2, L.DIMENSIONS), (2,)))

    def loss(e, w, b):
        z = np.array([w @ (s @ e[i]) + b for i, s in bags])
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(3), y]).sum())

    moved = [x.copy() for x in (embed, layer, bias)]
    L._step(*moved, bags, y, np.float32(1e-3))
    for k in range(2):
        for at in [(4, 3), (9, 0)] if k == 0 else [(0, 2), (1, 5)]:
            ahead, behind = ([x.copy() for x in (embed, layer, bias)] for _ in range(2))
            ahead[k][at] += 1e-2
            behind[k][at] -= 1e-2
            slope = (loss(*ahead) - loss(*behind)) / 2e-2
            gone = (embed, layer)[k][at] - moved[k][at]
            if k:
                assert gone == pytest.approx(1e-3 * slope, rel=0.05, abs=1e-6)
            else:  # a bag's step is scaled by the root of its size
                assert gone * slope > 0
    assert loss(*moved) < loss(embed, layer, bias)


def test_long_documents_are_learned_from(spark):
    rnd = random.Random(8)
    rows = [(k, text("bb" if k < 40 else "aa", rnd, 9000 if k < 40 else 30), "bb" if k < 40 else "aa", "x") for k in range(80)]
    model = L.fit(spark.createDataFrame(rows, FIELDS), longest=2000)
    assert model.languages == ["aa", "bb"]
    got = L.predict(spark.createDataFrame(rows, FIELDS), model).collect()
    assert sum(r.lang_pred == ("bb" if r.doc_id < 40 else "aa") for r in got) > 76


def test_the_sample_is_bounded_over_all_languages(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(L, "train", lambda texts, langs, seed: seen.update(n=len(texts), long=max(map(len, texts)), langs=len(set(langs))))
    rows = [(k, f"text {k} " * 50, f"l{k % 20:02d}", "x") for k in range(4000)]
    L.fit(spark.createDataFrame(rows, FIELDS), in_all=200, longest=100)
    assert seen["langs"] == 20 and 120 < seen["n"] < 300 and seen["long"] == 100


def test_held_out_labels_are_not_learned(spark, rows):
    odd = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else g, x) for i, t, g, x in rows]
    assert L.fit(spark.createDataFrame(odd, FIELDS)).languages == ["aa", "bb", "cc"]


def test_undetermined(spark, rows):
    docs = spark.createDataFrame([*rows, (900, None, None, ""), (901, "", "aa", ""), (902, "12 !? \n", "aa", ""), (None, "karo mita", "aa", ""), (903, "k" * 100_000, None, "")], FIELDS)
    got = {r.doc_id: r for r in L.predict(docs, L.fit(docs)).collect()}
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0 and not got[900].accepted
    assert got[None].lang_pred == "aa" and got[903].lang_pred in SOUNDS


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some words", None, "")], FIELDS)
    assert [r.lang_pred for r in L.predict(docs, L.fit(docs)).collect()] == ["und"]
    assert L.predict(docs.limit(0), L.fit(docs.limit(0))).count() == 0


def test_forgetting_words_changes_nothing(rows, monkeypatch):
    model = L.train([r[1] for r in rows], [r[2] for r in rows])
    free = [L.Predictor(model).predict(r[1]) for r in rows]
    monkeypatch.setattr(L, "WORDS_KEPT", 5)
    bound = L.Predictor(model)
    assert [bound.predict(r[1])[0] for r in rows] == [f[0] for f in free]


def test_every_part_of_a_document_may_be_learned_from(spark, monkeypatch):
    """Pieces that are taken together are the whole text, and all are taken where there are few."""
    seen = {}
    monkeypatch.setattr(L, "train", lambda texts, langs, seed: seen.update(texts=texts))
    whole = " ".join(f"word{k}" for k in range(5000))
    L.fit(spark.createDataFrame([(1, whole, "aa", "x"), (3, "", "aa", "x")], FIELDS), longest=700)
    assert "" in seen["texts"] and sum(map(len, seen["texts"])) == len(whole) and all(t in whole for t in seen["texts"])
    L.fit(spark.createDataFrame([(1, whole, "aa", "x")], FIELDS), longest=7, per_language=300)
    at = sorted(whole.find(t) for t in seen["texts"] if whole.count(t) == 1)
    assert 200 < len(seen["texts"]) < 400 and at[-1] > 0.95 * len(whole)
