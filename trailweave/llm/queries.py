"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.llm import (
    chat, exact_dedup, hard_negatives, language_id, line_dedup, packing, prefix_trie, quality, quality_classifier, sentencepiece_bpe, sharding, simhash, suffix_dedup,
)
from trailweave.llm.common import documents, tokenizer_path

#: The shards of the registered query.
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the chunks of lines that another has first."""
    return line_dedup.line_dedup(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated 200-byte strings."""
    return suffix_dedup.removal_digest(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = documents(spark, sf_dir)
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return sentencepiece_bpe.round_trip_digest(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, by its id."""
    placed = sharding.assign_shards(documents(spark, sf_dir).select("doc_id"), ["doc_id"], SHARDS)
    return placed.select("doc_id", "slot", "shard", "shard_name")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint and the near-duplicate component of every document."""
    groups = simhash.simhash_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document, and whether it stays."""
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    docs = documents(spark, sf_dir)
    pieces = packing.tokenised_pieces(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=False)
    return packing.pack(pieces, tasks=packing.tasks_for(docs))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule statistics of every document and whether it stays."""
    docs = documents(spark, sf_dir)
    forest = quality.fit(docs, documents(spark, sf_dir, "labels"))
    return quality.quality_rules(docs, forest)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that says control strings, formatted and read back."""
    return chat.round_trip_digest(chat.with_probe(documents(spark, sf_dir, "conversations")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every hundredth vector; every seventh has another label than the table says."""
    rows = documents(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select("vec_id", label.alias("label"), hard_negatives.scaled("embedding", 256).alias("vector"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, each begun as its family's first."""
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(documents(spark, sf_dir, "conversations")))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    docs = documents(spark, sf_dir)
    found = quality_classifier.scored(docs, quality_classifier.fit(docs, documents(spark, sf_dir, "labels")))
    return found.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name -> callable."""
    return {f.__name__: f for f in (op1_line_dedup, op2_suffix_dedup, op3_language_id, op4_sentencepiece, op5_sharding, op6_simhash, op7_exact_dedup, op8_packing, op9_quality_rules, op10_chat_formatting, op11_hard_negatives, op12_prefix_trie, op13_quality_classifier)}


def _sharding_sql() -> str:
    owners = ",".join(map(str, sharding.lookup_table(SHARDS)))
    return f"""
WITH placed AS (
  SELECT doc_id,
         CAST(CAST('0x' || substr(md5(coalesce('v' || CAST(doc_id AS VARCHAR), 'n')), 1, {sharding.KEY_DIGITS}) AS BIGINT)
              % {sharding.TABLE_SIZE} AS INTEGER) AS slot
  FROM documents),
owners AS (
  SELECT CAST(unnest(string_split('{owners}', ',')) AS INTEGER) AS shard,
         CAST(unnest(range({sharding.TABLE_SIZE})) AS INTEGER) AS slot)
SELECT doc_id, slot, shard, 'shard-' || lpad(CAST(shard AS VARCHAR), 3, '0') AS shard_name
FROM placed JOIN owners USING (slot)"""


EXACT_DEDUP_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND row_number() OVER (PARTITION BY t, doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)"""


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</', '<\/')) AS escaped,
         4 + length(role) + 2 + 8 AS marks
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(escaped + marks) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q, row_number() OVER () AS r
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, b.r,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, r AS positive, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor, anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor, positive ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 10"""


PREFIX_TRIE_SQL = """
WITH t AS (
  SELECT conv_id, length(coalesce(text, '')) AS chars, dense_rank() OVER (ORDER BY coalesce(role, ''), coalesce(text, '')) AS word,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT DISTINCT conv_id AS c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM conversations WHERE conv_id IS NOT NULL),
parts AS (
  SELECT c, 0 AS own, pos, word, chars FROM c JOIN t ON t.conv_id = c - c % 100 AND pos <= h
  UNION ALL SELECT c, 1, pos, word, chars FROM c JOIN t ON t.conv_id = c AND pos > h),
prefixes AS (
  SELECT c, 0 AS d, '' AS key, 0 AS chars FROM c
  UNION ALL
  SELECT c, row_number() OVER w, string_agg(CAST(word AS VARCHAR), ',') OVER (w ROWS UNBOUNDED PRECEDING), chars
  FROM parts WINDOW w AS (PARTITION BY c ORDER BY own, pos)),
nodes AS (SELECT key, min(c) AS id, min(d) AS d, count(*) AS n, min(chars) AS chars FROM prefixes GROUP BY key),
spots AS (SELECT c, nodes.d, id FROM prefixes JOIN nodes USING (key)),
linked AS (SELECT n.*, p.id AS up FROM nodes n LEFT JOIN spots p ON p.c = n.id AND p.d = n.d - 1),
children AS (SELECT up AS id, d - 1 AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT spots.id, spots.d, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n - 1) * n.chars) AS saved
  FROM nodes n LEFT JOIN children k ON k.id = n.id AND k.d = n.d JOIN spots ON spots.c = n.id AND spots.d <= n.d GROUP BY ALL),
ends AS (
  SELECT id, d, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends
  FROM spots JOIN (SELECT c, max(d) AS d FROM prefixes GROUP BY c) USING (c, d) GROUP BY ALL)
SELECT id AS conv_id, d AS depth, up AS parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM linked LEFT JOIN children USING (id, d) JOIN below USING (id, d) LEFT JOIN ends USING (id, d)"""


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL."""
    return {"op5_sharding": _sharding_sql(), "op7_exact_dedup": EXACT_DEDUP_SQL, "op10_chat_formatting": CHAT_SQL, "op11_hard_negatives": HARD_NEGATIVES_SQL, "op12_prefix_trie": PREFIX_TRIE_SQL}
