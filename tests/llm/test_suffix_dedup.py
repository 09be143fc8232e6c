"""The suffix sort, and removal of repeated 200-byte strings, against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from trailweave.llm import suffix_dedup as S
from trailweave.llm.suffix_array import suffix_array

FIELDS = "doc_id long, text string, spans string"


@pytest.mark.parametrize("seed", range(8))
def test_suffix_array(seed):
    rnd = random.Random(seed)
    for _ in range(150):
        n, letters = rnd.randint(0, 60), rnd.choice([1, 2, 3, 9])
        text = [rnd.randrange(letters) for _ in range(n)]
        if rnd.random() < 0.3:
            text = (text[: max(1, n // 4)] * 5)[:n]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def slow(texts):
    datas = [(t or "").encode() for t in texts]
    counts = Counter(d[k : k + 200] for d in datas for k in range(len(d) - 199))
    out = []
    for d in datas:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - 199):
            if counts[d[k : k + 200]] > 1:
                gone[k : k + 200] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone].tobytes())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    shared = [prose(60), prose(31), prose(45), "x" * 260, "ab" * 150, "中文" * 20 + prose(20), "".join(rnd.choices("ghijk", k=420))]
    texts = [None, "", "short", "y" * 199, "z" * 200, "z" * 200 + "!", "ab" * 300, "q" * 1500]
    for _ in range(40):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            parts.append(prose(rnd.randint(1, 60)))
            if rnd.random() < 0.6:
                s = rnd.choice(shared)
                a = rnd.randint(0, 20)
                parts.append(s[a : len(s) - rnd.randint(0, 20)])
        texts.append(rnd.choice(["", " "]).join(parts))
    for _ in range(8):
        copy = list(texts[rnd.randrange(10, 40)])
        for _ in range(rnd.randint(0, 3)):
            copy[rnd.randrange(len(copy))] = "#"
        texts.append("".join(copy))
    return texts


@pytest.mark.parametrize("block", [1 << 17, 150])
def test_windows_belong_to_one_anchor_and_equal_ones_agree(monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    by_window = {}
    for text in corpus(3):
        data = (text or "").encode()
        gram, first, last, _ = S.anchors(data)
        assert [w for a, b in zip(first, last) for w in range(a, b + 1)] == list(range(max(0, len(data) - 199)))
        for g, a, b in zip(gram.tolist(), first, last):
            for w in range(a, b + 1):
                assert by_window.setdefault(data[w : w + 200], g) == g


@pytest.mark.parametrize("seed", range(3))
def test_repeated_windows(seed):
    contexts = sorted({t.encode() for t in corpus(seed) if t and len(t.encode()) >= 200})
    for ends in (None, b" ", b"e", S.WORD_ENDS, S.word_end(contexts)):
        group = [c for c in contexts if ends is None or not S._long_word(ends).search(c)]
        counts = Counter(c[k : k + 200] for c in group for k in range(len(c) - 199))
        for c, again in zip(group, S.repeated_windows(group, ends)):
            assert again.tolist() == [counts[c[k : k + 200]] > 1 for k in range(len(c) - 199)]


@pytest.mark.parametrize(("seed", "hot", "most"), [(1, 2000, 9), (2, 2000, 9), (1, 1, 1000), (2, 3, 3), (1, 1, 1), (2, 1, 2), (2, 1, 0)])
def test_removal(spark, seed, hot, most):
    texts = corpus(seed)
    ids = list(range(len(texts)))
    ids[5], ids[6] = None, 7
    rows = [(i, t, "clash") for i, t in zip(ids, texts)]
    rows.append(rows[20])
    got = sorted((tuple(r) for r in S.removal_digest(spark.createDataFrame(rows, FIELDS), hot=hot, most=most).collect()), key=str)
    assert got == sorted(((i, *r) for (i, _, _), r in zip(rows, slow([t for _, t, _ in rows]))), key=str)


def test_a_passage_in_thousands_of_documents(spark):
    """Equal, nearly equal and differently framed: more distinct contexts than meet in a task."""
    rnd = random.Random(5)
    passage = "".join(rnd.choices("abcdefgh ", k=230))
    texts = []
    for k in range(6000):
        own = list(passage)
        if k % 3:
            own[rnd.randrange(230)] = "#"
        frame = "".join(rnd.choices("ijklmnop ", k=40))
        texts.append(("".join(own) if k % 2 else frame[:20] + "".join(own) + frame[20:]) if k % 5 else "".join(own))
    got = sorted(tuple(r)[1:] for r in S.removal_digest(spark.createDataFrame([(k, t, "") for k, t in enumerate(texts)], FIELDS)).collect())
    assert got == sorted(slow(texts)) and sum(r[1] > 0 for r in got) > 3000


def test_spans_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c " * 50, ""), (2, "unique text", "")], FIELDS)
    got = {r.doc_id: r for r in S.suffix_dedup(docs).collect()}
    assert got[2].spans == [] and got[2].kept == b"unique text"
    assert [(s.start, s.end) for s in got[1].spans] == [(0, 300)] and got[1].n_removed == 300
    assert S.removal_digest(docs.limit(0)).count() == 0
