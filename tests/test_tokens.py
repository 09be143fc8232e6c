"""Treebank tokens by example; subword ids against a plain longest match."""

import random

import pytest
from pyspark.sql import functions as F

from trailweave.functions import arrays
from trailweave.operators import subwords as S

EXAMPLES = {
    "He said: \"I can't.\"": "he said : `` i ca n't . ''",
    "(It's 3:30, isn't it?)": "-lrb- it 's 3:30 , is n't it ? -rrb-",
    "They'll pay 1,000 dollars; John's won't.": "they 'll pay 1,000 dollars ; john 's wo n't .",
    "cannot cannot gonna gotta gimme 'tis": "can not can not gon na got ta gim me 't is",
    "a -- b ... {c} [d] 50%": "a -- b ... -lcb- c -rcb- -lsb- d -rsb- 50 %",
    "One end. Another end.": "one end . another end .",
    "the dogs' bone": "the dogs ' bone",
    "": "",
    " \n\t ": "",
}


def test_treebank(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(EXAMPLES)], "k int, t string")
    got = {r.k: " ".join(r.w) for r in df.select("k", arrays.treebank("t").alias("w")).collect()}
    assert got == dict(enumerate(EXAMPLES.values()))


def slow(word, vocabulary, unknown):
    if len(word) > S.LONGEST:
        return [unknown]
    out, at = [], 0
    while at < len(word):
        n = next((n for n in range(len(word) - at, 0, -1) if ("##" if at else "") + word[at : at + n] in vocabulary), None)
        if n is None:
            return [unknown]
        out.append(vocabulary[("##" if at else "") + word[at : at + n]])
        at += n
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_longest_match(spark, seed):
    rng = random.Random(seed)
    vocabulary = {("##" if rng.random() < 0.5 else "") + "".join(rng.choices("abé", k=rng.randint(1, 4))): k + 20 for k in range(60)}
    texts = [" ".join("".join(rng.choices("abé", k=rng.randint(1, 9))) for _ in range(rng.randrange(12))) for _ in range(50)]
    texts += ["AB <hist>ab<hist> a,b", "a" * 101, "a" * 100, None, "", "<hist"]
    voc = spark.createDataFrame(list(vocabulary.items()), "token string, id long")
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: r.ids for r in S.encoded(df, "k", "t", voc, {"<hist>": 5}, 2, 1, most=4).collect()}
    for k, t in enumerate(texts):
        want = [1]
        for w in split(t or ""):
            want += [5] if w == "<hist>" else slow(w.lower(), vocabulary, 2)
        assert got[k] == want


def split(text):
    import re

    return re.findall(r"<hist>|\w+|[^\s\w]", text)


def test_left_batches(spark):
    rows = spark.createDataFrame([(0, 0, [1, 2, 3]), (1, 0, [4]), (2, 1, list(range(9)))], "k int, batch int, ids array<long>")
    got = {r.k: (r.input_ids, r.attention_mask) for r in S.left_batches(rows, "batch", 4, 0).collect()}
    assert got == {0: ([1, 2, 3], [True] * 3), 1: ([0, 0, 4], [False, False, True]), 2: ([5, 6, 7, 8], [True] * 4)}
    assert not S.left_batches(rows.where(F.col("k") > 5), "batch", 4, 0).count()


def test_words_become_ids_where_their_text_is(spark, monkeypatch):
    """Nothing is dealt or joined by words; words beyond those remembered are taken apart anew."""
    monkeypatch.setattr(S, "REMEMBERED", 1)
    voc = spark.createDataFrame([("a", 20), ("ab", 21), ("abcd", 22), ("##c", 23), ("##cd", 24), ("##dé", 25)], "token string, id long")
    df = spark.createDataFrame([(1, "abc abcd abcdé ABCDÉ <hist>"), (1, "x"), (None, "abcddé ab")], "k long, t string")
    made = S.encoded(df, "k", "t", voc, {"<hist>": 5}, 2, 1, most=4)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert [(r.k, r.ids) for r in made.collect()] == [(1, [1, 21, 23, 22, 2, 2, 5]), (1, [1, 2]), (None, [1, 22, 25, 21])]
    pieces = S.Pieces({"ab": 1, "##c": 2}, {"<hist>": 5}, 9, 4)
    assert [pieces[w] for w in ("abc", "<hist>", "abcc", "b", "c")] == [(1, 2), (5,), (1, 2, 2), (9,), (9,)] and len(pieces) == 1
