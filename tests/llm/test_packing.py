"""Tokenised pieces against the tokenizers library; packing against its invariants and a plain best-fit."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailweave.llm import packing as K
from trailweave.llm.byte_bpe import ByteBpe
from trailweave.llm.common import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_path("byte_bpe_50k.json")
FIELDS = "doc_id long, text string, offset string"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_ids_match_the_library(library):
    with open(PATH, "rb") as f:
        fast = ByteBpe(f.read())
    assert fast.fast is not None
    rnd = random.Random(4)
    parts = list("abcdehinorst   \n\t éü日\"'.,01<|") + ["'s ", "the ", "  ", "\x00", "　", "\x85", "\x1c", "<|endoftext|>", "\n\n", "𠀋", "a" * 600, " " * 300]
    for _ in range(1500):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 50)))
        assert fast.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


SPECIAL = "<|endoftext|>"


@pytest.mark.parametrize("text", [SPECIAL, f"a{SPECIAL}b", f"{SPECIAL}{SPECIAL} x", f"x {SPECIAL}", "<|endoftext|", "<|ENDOFTEXT|>", "a " * 1022 + SPECIAL + " b", "a " * 1023 + SPECIAL + SPECIAL])
def test_added_tokens(library, text):
    with open(PATH, "rb") as f:
        ids = library.encode(text, add_special_tokens=False).ids
        assert ByteBpe(f.read()).encode(text) == np.array(ids, "<u4").tobytes()
    assert (SPECIAL in text) == (library.token_to_id(SPECIAL) in ids)


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 2048, 2049, 5000])
def test_cuts(n):
    got = K.cuts(n)
    assert got[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(got, got[1:])) and sum(b for _, b in got) == n
    assert all(b == 1024 for _, b in got[1:]) and 1 <= got[0][1] <= 1024


@pytest.mark.parametrize("limit", [1, 3, 20])
def test_best_fit_against_a_plain_one(limit):
    rnd = random.Random(limit)
    packer, free, made = K.BestFit(64, limit), {}, 0
    for _ in range(3000):
        n = rnd.choice([rnd.randint(1, 64), rnd.randint(1, 9)])
        number, offset = packer.place(n)
        fits = [s for s in free.values() if s >= n]
        if fits:
            assert free[number] == min(fits)
        else:
            if len(free) == limit:
                fullest = [b for b, s in free.items() if s == min(free.values())]
                gone = [b for b in fullest if b not in {x for held in packer.bins for x in held}]
                assert len(gone) == 1
                del free[gone[0]]
            assert number == made
            free[number], made = 64, made + 1
        assert offset == 64 - free[number]
        free[number] -= n
        if not free[number]:
            del free[number]
        assert {b: s for s, held in enumerate(packer.bins) for b in held} == free and packer.open == len(free)


def test_packed_documents(spark, library):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choices(["the", "of", "Zusammenhang", "x\ny", "é"], k=rnd.choice([0, 5, 80, 900, 4000]))), "clash") for i in range(150)]
    rows += [(500, None, ""), (501, "", ""), (7, rows[7][1], ""), (502, f"a {SPECIAL} b", ""), (503, "the of " * 511 + SPECIAL * 3, ""), (None, "null id", "")]
    docs = spark.createDataFrame(rows, FIELDS)
    packed = K.pack(K.tokenised_pieces(docs, PATH)).cache()
    got = packed.collect()
    where = defaultdict(list)
    for r in got:
        where[r.sequence_id].append((r.offset, r.length))
    for held in where.values():
        held.sort()
        assert held[0][0] == 0 and all(o + n == p for (o, n), (p, _) in zip(held, held[1:])) and sum(held[-1]) <= 1024
    want = sorted(
        (str(i), p, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))
        for i, t, _ in rows
        for ids in [library.encode(t or "", add_special_tokens=False).ids + [2]]
        for p, (s, n) in enumerate(K.cuts(len(ids)))
    )
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    least = -(-sum(r.length for r in got) // 1024)
    assert len(where) <= 1.1 * least + 4
    for r in K.sequences(packed).collect():
        assert len(r.ids) == sum(n for _, n in where[r.sequence_id]) and len(r.starts) == len(where[r.sequence_id])
    assert K.pack(K.tokenised_pieces(docs.limit(0), PATH, with_ids=False)).count() == 0


def test_few_sequences_at_any_number_of_partitions(spark):
    """By the number of tasks that suits the texts, whatever the session's own number is; one id and no ids are no hot key."""
    rnd = random.Random(10)
    lengths = [rnd.choice([rnd.randint(1, 1024), rnd.randint(1, 200)]) for _ in range(6000)]
    rows = [(None if k % 3 else 7, 0, 0, n, k, "x") for k, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, offset string").repartition(40)
    docs = spark.createDataFrame([("x" * 1000,), (None,)], "text string")
    assert K.tasks_for(docs) == 1 and K.tasks_for(docs.limit(0)) == 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        packed = K.pack(pieces, tasks=K.tasks_for(docs))
        n = packed.select("sequence_id").distinct().count()
        spread = K.pack(pieces).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert n <= 1.02 * -(-sum(lengths) // 1024)
    assert len(spread) > 50 and spread.max() < 3 * spread.mean()
