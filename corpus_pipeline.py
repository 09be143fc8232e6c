"""The corpus pipeline: five stages over ``documents``, each of which works on all its predecessor kept.

What all stages have in common: other columns than ``doc_id`` and ``text`` may have any names and are kept
(but for ``n_chars``, which follows the text); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import jaccard, line_dedup, packing, quality, suffix_dedup
from trailweave.llm.common import documents, dropped, shared_folder, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Words below which a document is rejected without the forest.
FEWEST_WORDS = 1


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the forest reject go.

    Null, empty and white-space-only texts go; short ones are left to the forest, as clean documents may be
    short (the query's contract has 20 words at least): a text of one plain word stays. The verdict is the text's alone, so repeated rows
    and rows without an id share it, and a very long text is judged as a whole.
    """
    forest = quality.fit(docs, documents(spark, sf_dir, "labels"), min_words=FEWEST_WORDS)
    return quality.filtered(docs, forest, min_words=FEWEST_WORDS)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that stand elsewhere first go from the texts.

    No row goes; a null text stays null, and one that loses all its lines is empty. Rows without an id come
    last, and of rows that repeat id and text one keeps what they share.
    """
    return _counted(line_dedup.deduplicated(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id stays.

    Null, empty and white-space-only texts are one group. Rows without an id stay, and rows that repeat the
    id that stays do too.
    """
    return jaccard.near_dedup(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes that a repeated 200-byte string covers go from the texts, and characters that this cuts in two.

    No row goes; null texts become empty. Repeated rows are documents of their own, so they lose all that is
    long enough.
    """
    return _counted(suffix_dedup.deduplicated(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and their places in sequences of 1024.

    A null or empty text is one piece of just the end id; repeated rows are packed each; other columns go.
    ``packing.sequences`` makes whole sequences of the result.
    """
    return packing.pack(packing.tokenised_pieces(docs, tokenizer_path("byte_bpe_50k.json")), tasks=packing.tasks_for(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_chunks),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeated_passages),
    ("best_fit_packing", packed),
]

#: SQL can't express the forest, the rolling hashes or the tokenizer; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and deleted once the next is there."""
    docs, folder, before = documents(spark, sf_dir), shared_folder(spark), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            dropped(spark, before)
        before = path
    return docs
