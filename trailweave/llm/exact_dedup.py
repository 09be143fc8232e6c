"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep the smallest id.

All of it is DataFrame operators. Texts are grouped by (hash, bytes): the hash spreads the rows and
the hash aggregate compares the bytes, so two texts that collide stay apart. The first aggregation
runs on the map side, so a text that a third of all rows share sends one row per task. Each group then
has a name of 24 bytes by which documents learn it. The ``HOT_GROUPS`` largest groups are sent to all
tasks; what is left for the join by name has no name with more than 1 / HOT_GROUPS of all rows.

Defined cases: a null text is empty; a null id is never the smallest unless all ids of the group are
null; of rows that repeat id and text one is kept if that id is the group's smallest (they are counted
and then told apart by number); an empty table gives an empty result. Only the id and the text are read,
so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import durable, whole_text

#: Groups that are broadcast, the largest first: so many rows of some 100 bytes at any scale.
HOT_GROUPS = 1000


def content_hash(text: Column) -> Column:
    """128 bits of the text, as 16 bytes."""
    return F.unhex(F.md5(text))


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; the pattern is only for texts that have a run then."""
    for control in "\t\n\v\f\r":
        text = F.replace(text, F.lit(control), F.lit(" "))
    return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``hash_of`` is the grouping hash. A weak one only costs speed: groups are still told apart by
    their bytes.
    """
    rows = (
        df.select(F.col(id_col).alias("id"), normalised(whole_text(text_col)).alias("text"))
        .withColumn("hash", hash_of(F.col("text")))
        .withColumn("more", F.xxhash64(F.lit(7), "text"))
    )
    groups = rows.groupBy("hash", "text").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("size"))
    # (hash, more) names a text for the join back; that it names one text only is checked, not assumed.
    named = groups.select("hash", F.xxhash64(F.lit(7), "text").alias("more"), "keep", "size", F.unhex(F.sha2("text", 256)).alias("sha"))
    named = named.groupBy("hash", "more").agg(F.min("keep").alias("keep"), F.sum("size").alias("size"), F.min("sha").alias("sha"), F.count(F.lit(1)).alias("texts"))
    one = F.when(F.col("texts") == 1, F.col("size")).otherwise(F.raise_error(F.lit("two texts share both content hashes")).cast("long"))
    named = durable(named.select(F.col("hash").alias("h"), F.col("more").alias("m"), "keep", one.alias("size"), "sha"))
    hot = named.where("size > 1").orderBy(F.desc("size"), "h", "m").limit(HOT_GROUPS)

    copies = rows.groupBy("id", "hash", "more").agg(F.count(F.lit(1)).alias("n"))
    same = (F.col("hash") == F.col("h")) & (F.col("more") == F.col("m"))
    found = copies.join(F.broadcast(hot), same).unionByName(copies.join(F.broadcast(hot), same, "left_anti").join(named, same))
    first = F.col("id").eqNullSafe(F.col("keep"))
    each = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return each.select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        (first & (F.col("k") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )
