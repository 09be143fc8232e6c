"""The forms of operators that keep all columns, as the pipeline uses them."""

from trailweave.llm import line_dedup, quality, suffix_dedup

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
LINES = "\n".join(f"line number {k} with some words" for k in range(12))
PASSAGE = "passage that repeats across documents " * 8


def test_line_dedup_keeps_columns(spark):
    rows = [(1, LINES, "en", "a", 1), (2, "head\n" + LINES, "fr", "b", 2), (3, None, "de", "c", 3), (4, "alone", None, None, None)]
    docs = spark.createDataFrame(rows, FIELDS)
    got = {r.doc_id: r for r in line_dedup.deduplicated(docs).collect()}
    want = {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()}
    assert {i: r.text for i, r in got.items()} == want and got[1].text == LINES and len(got[2].text) < len(LINES)
    assert [tuple(got[i])[2:] for i in (1, 2, 3, 4)] == [r[2:] for r in rows]


def test_suffix_dedup_keeps_columns_and_whole_characters(spark):
    rows = [(1, "éa" + PASSAGE + "é", "en", "a", 1), (2, "b" + PASSAGE + "c", "fr", "b", 2), (3, None, "de", "c", 3), (4, "alone", None, None, None)]
    got = {r.doc_id: r for r in suffix_dedup.deduplicated(spark.createDataFrame(rows, FIELDS)).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == ["éaé", "bc", "", "alone"]
    assert [tuple(got[i])[2:] for i in (1, 2, 3, 4)] == [r[2:] for r in rows]


def test_quality_keeps_columns(spark):
    rows = [(1, " ".join(f"word{k}" for k in range(40)), "en", "a", 1), (2, "short", "fr", "b", 2), (3, None, None, None, None)]
    assert [tuple(r) for r in quality.filtered(spark.createDataFrame(rows, FIELDS), None).collect()] == rows[:1]
