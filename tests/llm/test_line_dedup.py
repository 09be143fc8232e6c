"""Line chunks and their removal, against brute force."""

import random
from collections import defaultdict

import pytest

from trailweave.llm import line_dedup as L

FIELDS = "doc_id long, text string, own string"


def corpus(seed):
    rnd = random.Random(seed)
    line = lambda: " ".join(rnd.choices("alpha beta gamma delta é ß eta theta".split(), k=rnd.randint(1, 6)))
    shared = [[line() for _ in range(rnd.randint(4, 9))] for _ in range(4)] + [["", " ", ""], ["same"] * 6]
    texts = [None, "", "\n", "one line", "a\nb"]
    for _ in range(40):
        lines = []
        for _ in range(rnd.randint(1, 4)):
            lines += [line() for _ in range(rnd.randint(0, 4))]
            if rnd.random() < 0.6:
                lines += rnd.choice(shared)
        texts.append("\n".join(lines))
    return texts


def slow(rows):
    """First occurrence by (id, hashes of the row, place), null ids last; whole chunks compared as text. Rows: (id, text, r1, r2)."""
    cuts = {t: [(a, b, c) for a, b, c in L.candidates((t or "").split("\n"))] for _, t, _, _ in rows}
    places, first, out, copies = defaultdict(list), {}, [], set()
    for i, t, r1, r2 in rows:
        for a, _, c in cuts[t]:
            places[c].append((i is None, i or 0, r1, r2, a))
    first = {c: min(p) for c, p in places.items() if len(p) > 1}
    for i, t, r1, r2 in rows:
        lines = t.split("\n") if t else []
        again, gone, cut = (r1, r2) in copies, set(), 0
        copies.add((r1, r2))
        for a, b, c in cuts[t] if t else []:
            if c in first and (again or first[c] != (i is None, i or 0, r1, r2, a)):
                gone |= set(range(a, b))
                cut += 1
        out.append((i, len(lines), len(gone), cut, "\n".join(x for k, x in enumerate(lines) if k not in gone) if t else t))
    return out


def test_borders_resist_shifts():
    rnd = random.Random(2)
    lines = [f"line {rnd.random()}" for _ in range(200)]
    whole = {c for _, _, c in L.candidates(lines)}
    moved = {c for _, _, c in L.candidates(["new"] * 3 + lines)}
    assert len(whole & moved) >= len(whole) - 3 * L.CUTTINGS


@pytest.mark.parametrize("seed", range(3))
def test_removal(spark, seed, monkeypatch):
    texts = corpus(seed)
    ids = random.Random(seed).sample(range(100, 900), len(texts))
    rows = list(zip(ids, texts))
    rows += [rows[9], rows[20], (None, texts[12]), (None, texts[30] + "\n" + texts[30])]
    rows += [(ids[7], texts[13]), (ids[7], texts[14]), (None, texts[12])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], FIELDS)
    keyed = [(r.id, r.text, r.r1, r.r2) for r in L._rows(docs, "doc_id", "text", []).collect()]
    got = sorted((tuple(r) for r in L.line_dedup(docs).collect()), key=str)
    assert got == sorted(slow(keyed), key=str)
    assert sum(r[2] for r in got) > 20
    # whatever goes, one of every line stays: judged by lines alone, without chunks
    before, after = ({x for t in texts_ if t for x in t.split("\n") if x.strip()} for texts_ in ([t for _, t in rows], [r[4] for r in got]))
    assert before == after
    monkeypatch.setattr(L, "HOT_CHUNKS", 2)
    assert got == sorted((tuple(r) for r in L.line_dedup(docs).collect()), key=str)


def test_a_shared_hash_removes_nothing(spark):
    docs = spark.createDataFrame([(k, f"a {k // 2}\nb {k // 2}", "") for k in range(6)], FIELDS)
    rows = L._rows(docs, "doc_id", "text", [])
    found = L.repeated_chunks(rows)
    assert found.count() == 6 and L.unequal_chunks(rows, found).count() == 0
    import xxhash

    real = xxhash.xxh3_128_digest
    weak = type("Weak", (), {"xxh3_128_digest": staticmethod(lambda data: real(data[:1])), "xxh64_intdigest": xxhash.xxh64_intdigest})
    scope, old = L.unequal_chunks.__globals__, xxhash
    scope["xxhash"] = weak  # all chunks share a hash now
    try:
        found = L.repeated_chunks(rows)
        assert found.select("hash").distinct().count() == 1 and L.unequal_chunks(rows, found).count() == 1
        assert [r.n_removed_lines for r in L.line_dedup(docs).collect()] == [0] * 6
    finally:
        scope["xxhash"] = old


def test_empty(spark):
    assert L.line_dedup(spark.createDataFrame([], FIELDS)).count() == 0


def test_chunks_cover_all_lines_and_have_two_with_a_word():
    for t in [t for seed in range(3) for t in corpus(seed) if t] + ["\n".join(f"line {k}" for k in range(500))]:
        lines = t.split("\n")
        borders, worded = L.chunks(lines), [bool(x.strip(L._WHITE)) for x in lines]
        if sum(worded) >= 2:
            assert {x for a, b in borders for x in range(a, b)} == set(range(len(lines)))
            assert all(sum(worded[a:b]) >= 2 for a, b in borders)


#: The least share of the lines of a passage of so many lines that must go from its second document.
RECALL = {2: 0.25, 3: 0.5, 5: 0.75, 7: 0.85, 10: 0.9, 20: 0.94, 50: 0.97}


def test_shared_passages_are_caught():
    rnd, caught = random.Random(8), dict.fromkeys(RECALL, 0)
    line = lambda: f"line {rnd.random()}"
    for n in caught:
        for _ in range(300):
            shared = [line() for _ in range(n)]
            one, other = ([line() for _ in range(rnd.randint(0, 9))] + shared + [line() for _ in range(rnd.randint(0, 9))] for _ in range(2))
            known = {c for _, _, c in L.candidates(one)}
            caught[n] += len({k for a, b, c in L.candidates(other) if c in known for k in range(a, b)}) / n / 300
    assert all(caught[n] >= least for n, least in RECALL.items()), caught
