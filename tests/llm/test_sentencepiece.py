"""The prefix-table codec against the sentencepiece library."""

import hashlib
import random

import pytest

from trailweave.llm import sentencepiece_bpe as S
from trailweave.llm.common import tokenizer_path

spm = pytest.importorskip("sentencepiece")
PATH = tokenizer_path("piece_bpe_32k.model")
CASES = ["", " ", "a", "  a b  c\n\nd", " ﬁ ①　x", "<s> <0x0A> </s> <unk>", "▁x", "▁", "a\x00b", "日本語 𠀋", " " * 70, "x" * 300, "▁ ▁", "\n", " \n ", "é"]


@pytest.fixture(scope="module")
def codec():
    return S.Codec(S.Vocabulary.load(PATH))


@pytest.fixture(scope="module")
def library():
    return spm.SentencePieceProcessor(model_file=PATH)


@pytest.mark.parametrize("text", CASES)
def test_cases(codec, library, text):
    ids = library.encode(text)
    assert codec.encode(text) == ids
    assert codec.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("seed", range(5))
def test_random(codec, library, seed):
    rnd = random.Random(seed)
    parts = list("abcdehilnorst  \n\t▁éüß日本語𠀋\"'().,0123ABC<>s/|") + ["▁▁", "ing", "the ", "    ", "http", "\x00"]
    for _ in range(400):
        text = "".join(rnd.choices(parts, k=rnd.randint(0, 80)))
        ids = library.encode(text)
        assert codec.digest(text) == (len(ids), ",".join(map(str, ids)), library.decode(ids))


def test_prefix_table_is_the_last_token_of_every_prefix(codec, library):
    text = "▁internationalisation"
    for end, last in enumerate(codec.prefix_table(text), 1):
        assert codec.tokens[last] == codec.merged(text[:end])[-1]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(S, "PIECES_KEPT", 3)
    monkeypatch.setattr(S, "PAIRS_KEPT", 5)
    codec = S.Codec(S.Vocabulary.load(PATH))
    text = "to be or not to be, that is the question of the day or not"
    for _ in range(3):
        assert codec.encode(text) == library.encode(text)


def test_frames(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world", "x"), (3, "Hello  world", "x"), (None, "é" * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted(map(tuple, S.round_trip_digest(docs, PATH).collect()), key=str)
    want = [(i, len(e := library.encode(t or "")), sha(",".join(map(str, e))), sha(library.decode(e) if e else "")) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    ids = S.encode_texts(docs, PATH)
    assert sorted((r.text for r in S.decode_ids(ids, PATH).collect())) == sorted(t or "" for _, t, _ in rows)
    assert S.round_trip_digest(docs.limit(0), PATH).count() == 0
