"""The corpus pipeline against its stages run by hand on a small corpus."""

import random

import corpus_pipeline as P
from trailweave.llm import packing

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(3, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    passage, lines = prose(70), "\n".join(prose(9) for _ in range(10))
    texts = {k: prose(rnd.randint(60, 200)) for k in range(60)}
    texts |= {k: " ".join(w + "###" for w in texts[k - 60].split()) for k in range(60, 75)}  # junk
    texts |= {80: texts[1], 81: texts[2] + " more", 90: prose(40) + " " + passage, 91: prose(45) + passage, 95: prose(30) + "\n" + lines, 96: prose(35) + "\n" + lines, 97: None, 98: "short"}
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, FIELDS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(not 60 <= k < 75)) for k in texts], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES:
        made = stage(spark, docs, str(tmp_path))
        seen[name] = {r[0]: r for r in made.collect()}
        if name != "best_fit_packing":
            assert made.columns == docs.columns
            docs = spark.createDataFrame(made.collect(), FIELDS)
    junk = set(range(60, 75)) | {97}
    assert set(seen["quality_rules"]) == set(texts) - junk  # 98, a single word, stays
    assert set(seen["line_dedup"]) == set(seen["quality_rules"])
    assert len(seen["line_dedup"][96].text) < len(texts[96]) and seen["line_dedup"][95].text == texts[95]
    assert 80 not in seen["simhash_near_dedup"] and {1, 90, 91, 95} <= set(seen["simhash_near_dedup"])
    assert set(seen["suffix_array_dedup"]) == set(seen["simhash_near_dedup"])
    assert passage[5:-5] not in seen["suffix_array_dedup"][90].text and seen["suffix_array_dedup"][5].text == texts[5]
    assert all(r.n_chars == len(r.text) for r in seen["suffix_array_dedup"].values())
    whole = P.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids))
    assert {r.doc_id for r in whole} == set(seen["suffix_array_dedup"])
    assert sorted(map(key, whole)) == sorted(map(key, packing.pack(packing.tokenised_pieces(docs, P.tokenizer_path("byte_bpe_50k.json"))).collect()))


def test_written_tables_are_deleted_but_for_the_last(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(f"word{k}" for k in range(40)), "en", "s", 9)], FIELDS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    made = P.run(spark, str(tmp_path))
    left = {f.split("/tables-")[1].split("/")[1] for f in made.inputFiles()}
    assert left == {"best_fit_packing"} and made.count() == 1
    import os

    folder = os.path.dirname(os.path.dirname(made.inputFiles()[0].removeprefix("file:")))
    assert os.listdir(folder.replace("///", "/")) == ["best_fit_packing"]
