"""METEOR: stems, alignments against all alignments, and scores worked out by hand."""

import itertools
import os
import random

import pytest

from trailweave.operators import meteor as M
from trailweave.operators.stemming import stems
from trailweave.plans import registry

SF = "/root/testdata/sf0.001"
STEMS = """consign consign,consigned consign,consignment consign,generously generous,hopping hop,hoping hope,happy happi,relational relat,conditional condit,rational ration,dying die,skies sky,cried cri,ties tie,
kiwis kiwi,gas gas,this this,luxuriating luxuri,agreed agre,plastered plaster,motoring motor,sing sing,troubled troubl,falling fall,hissing hiss,fizzed fizz,filing file,sensational sensat,effective effect,
hesitanci hesit,digitizer digit,feudalism feudal,decisiveness decis,hopefulness hope,formaliti formal,sensitiviti sensit,sensibiliti sensibl,triplicate triplic,formative format,electrical electr,goodness good,
revival reviv,allowance allow,inference infer,adjustable adjust,irritant irrit,replacement replac,adjustment adjust,adoption adopt,communism communism,activate activ,probate probat,rate rate,cease ceas,
controll control,roll roll,enjoy enjoy,by by,say say,cry cri,beautiful beauti,community communiti,general general,bed bed,shed shed,proceed proceed,youth youth,is is,news news,knightly knight,dog's dog,bluely blueli,
vileli vile,apologies apolog,yellowing yellow,succeeding succeed,national nation,quickly quick"""


def test_stems(spark):
    want = dict(x.split() for x in STEMS.replace("\n", "").split(","))
    want["vileli"] = "vile"
    got = {r.word: r.stem for r in stems(spark.createDataFrame([(w,) for w in want], "word string")).collect()}
    assert got == want


def every(hyp, ref):
    """The best of all one-to-one alignments."""
    best = None

    def walk(i, used, pairs):
        nonlocal best
        if i == len(hyp):
            found = (len(pairs), -M.chunks(pairs), -sum(abs(a - b) for a, b in pairs))
            best = max(best, found) if best else found
            return
        walk(i + 1, used, pairs)
        for j, w in enumerate(ref):
            if w == hyp[i] and j not in used:
                walk(i + 1, used | {j}, [*pairs, (i, j)])

    walk(0, frozenset(), [])
    return best


def test_alignments_are_the_best():
    rng = random.Random(4)
    for n, m, letters in itertools.product((0, 1, 4, 6), (0, 3, 6), ("a", "ab", "abcd")):
        for _ in range(4):
            hyp, ref = ([rng.choice(letters) for _ in range(k)] for k in (n, m))
            pairs = M.aligned(hyp, hyp, ref, ref, beam=10**6)
            assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs) and all(hyp[i] == ref[j] for i, j in pairs)
            want = every(hyp, ref)
            assert (len(pairs), -M.chunks(pairs), -sum(abs(a - b) for a, b in pairs)) == want
            assert len(M.aligned(hyp, hyp, ref, ref, beam=1)) <= want[0]


def scored(spark, rows):
    return M.best(M.counts(spark.createDataFrame(rows, "id long, hyp string, refs array<string>")))


def test_scores(spark):
    filler = " ".join(f"q{k}" for k in range(1, 40))  # so that no word but the is frequent
    rows = [
        (1, "the cat sat", ["the cat sat", "a dog"]), (2, "sat cat the", ["the cat sat"]), (3, "nothing alike", ["the cat sat"]), (4, "", ["the cat sat"]), (5, None, [""]), (6, "cats sit", ["cat sits"]),
        (7, "The CAT, sat.", ["the cat, sat."]), (8, filler, [filler]),
    ]
    got = {r.id: r for r in scored(spark, rows).collect()}
    assert got[1].meteor == 1 and got[7].meteor == 1 and got[8].meteor == 1
    assert got[3].meteor == got[4].meteor == got[5].meteor == 0
    assert got[2].matched == got[2].chunks == 3 and got[2].meteor == pytest.approx(1 - 0.6)
    assert got[6].matched == 2 and got[6].chunks == 1 and got[6].meteor == pytest.approx(M.STEM)


def test_function_words_weigh_less(spark):
    """Both replies get one of two words; the content word counts more."""
    body = [(k, "x", [" ".join(["the"] + [f"w{k}x{j}" for j in range(20)])]) for k in range(10, 110)]
    got = {r.id: r for r in scored(spark, [(1, "the hill", ["the river"]), (2, "some river", ["the river"]), *body]).collect()}
    assert got[1].function == 1 and got[2].content == 1
    p1, p2 = 0.25 / (0.75 + 0.25), 0.75 / (0.75 + 0.75)
    r1, r2 = 0.25 / 1.0, 0.75 / 1.0
    want = [p * r / (0.85 * p + 0.15 * r) * (1 - 0.6) for p, r in ((p1, r1), (p2, r2))]
    assert [got[1].meteor, got[2].meteor] == pytest.approx(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the benchmark tables are not here")
def test_queries(spark):
    rows = registry.queries()["txt07_meteor"](spark, SF).collect()
    assert rows and all(0 <= r.meteor <= 1 for r in rows) and any(r.meteor > 0.05 for r in rows)
    total = registry.queries()["txt07_meteor_corpus"](spark, SF).first().meteor
    assert min(r.meteor for r in rows) < total < max(r.meteor for r in rows)
