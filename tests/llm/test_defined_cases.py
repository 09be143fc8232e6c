"""Every operator and stage over tables that hold all that may go wrong at once."""

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from trailweave.llm import chat, exact_dedup, jaccard, language_id, line_dedup, packing, quality, sentencepiece_bpe, sharding, simhash, suffix_dedup
from trailweave.llm.common import tokenizer_path

#: Names that helpers use inside, or might.
NAMES = (
    "_id _good _row _r _lists _text _key _first _keep _hash i t l id text_ key good first rest r r1 r2 s1 s2 h n at hash repeated copy kept_at digest fp node a b o fp_ gram context owner "
    "spans start end kept k m sha size hot c x w of lang_pred score accepted ids piece length offset sequence_id slot shard shard_name component_id n_words base_failed keep_id group_size"
).split()
LONG = "\n".join(f"line{k} of{k % 13} a very long{k % 977} text{k} with some words{k}" for k in range(110_000))  # over 5 MB
PROSE = " ".join(f"word{k}" for k in range(60))
ROWS = [(1, PROSE), (2, PROSE), (2, PROSE), (None, PROSE), (None, None), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (7, "x\ny\n" + PROSE), (8, "x\ny\nelse"), (9, "\u00e9" * 300), (9, "other text of the id")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df = df.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    return df.select("*", *(F.lit("clash").alias(c) for c in NAMES)).cache()


@pytest.fixture(scope="module")
def labels(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (6, None), (7, 1), (7, 0)], "doc_id long, quality int")
    return df.select("*", *(F.lit("clash").alias(c) for c in NAMES if c != "quality"))


def operators(labels):
    return {
        "line_dedup": line_dedup.line_dedup,
        "suffix_dedup": suffix_dedup.removal_digest,
        "language_id": lambda d: language_id.predict(d, language_id.fit(d)),
        "sentencepiece": lambda d: sentencepiece_bpe.round_trip_digest(d, tokenizer_path("piece_bpe_32k.model")),
        "sharding": lambda d: sharding.assign_shards(d.select("doc_id"), ["doc_id"], ["p", "q", "r"]),
        "simhash": simhash.simhash_groups,
        "near_copies": jaccard.near_copy_groups,
        "exact_dedup": exact_dedup.exact_dedup,
        "packing": lambda d: packing.pack(packing.tokenised_pieces(d, tokenizer_path("byte_bpe_50k.json"))).where("piece = 0"),
        "quality": lambda d: quality.quality_rules(d, quality.fit(d, labels)),
    }


def test_operators(docs, labels):
    for name, run in operators(labels).items():
        ids = [r.doc_id for r in run(docs).select("doc_id").collect()]
        assert len(ids) == len(ROWS) and ids.count(None) == 2, name
        assert run(docs.limit(0)).count() == 0, name


def test_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    found = {}
    for name, stage in P.STAGES:
        made = stage(spark, docs, str(tmp_path))
        found[name] = made.collect()
        assert not stage(spark, docs.limit(0), str(tmp_path)).count(), name
        if name != "best_fit_packing":
            assert made.columns == docs.columns, name
            assert all(r._lists == "clash" and r.keep_id == "clash" for r in found[name]), name
    kept = {(r.doc_id, r.text[:4]) for r in found["quality_rules"]}
    assert {1, 2, None} <= {i for i, _ in kept} and not {i for i, _ in kept} & {3, 4, 5}
    lines = found["line_dedup"]
    assert len(lines) == len(ROWS) and sum(r.text is None for r in lines) == 2
    near = [(r.doc_id, r.text) for r in found["simhash_near_dedup"]]
    assert sorted((i for i, t in near if t == PROSE), key=str) == [1, None] and [i for i, _ in near].count(9) == 2
    assert {r.doc_id: len(r.text) for r in found["suffix_array_dedup"]}[1] < len(PROSE)
    assert len([r for r in found["best_fit_packing"] if r.piece == 0]) == len(ROWS)


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, None, None, "x"), (2, 0, "user", "y" * 5_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *(F.lit("clash").alias(c) for c in NAMES))
    assert {r.conv_id: r.n_turns for r in chat.round_trip_digest(chat.with_probe(df)).collect()} == {1: 3, None: 1, 2: 1, -7: 2}
    assert chat.round_trip_digest(df.limit(0)).count() == 0
