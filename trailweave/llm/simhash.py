"""SimHash near-dedup with multi-index hashing.

A document's fingerprint has a bit set where over half the hashes of its word shingles have it set.
Two fingerprints link if they differ in at most ``max_bits`` bits. To find all such pairs without
comparing all, a fingerprint is cut into two 32-bit segments A and B. If two fingerprints differ in
d bits at most, then either A differs in at most d // 2 bits or B in at most (d - 1) // 2. So every
fingerprint enumerates the small Hamming ball around its segment and looks each member up in a table
of all segments. A member that is k flips away leaves d - k differences for the other segment; cut
into d - k + 1 blocks, one block is the same, and is made part of the look-up key, which keeps
buckets small even where very many fingerprints share a segment. Matches are verified on all 64 bits
inside the join. Of two fingerprints only the one whose lowest flipped bit is 0 looks the other up.

Only distinct fingerprints take part, so copies cost nothing and lose no link. All links are kept;
there is no cap on buckets.

Defined cases: null, empty and white-space-only texts have fingerprint zero and link like any other;
texts shorter than a shingle hash as one shingle; repeated rows get the same result; a component of
rows whose ids are all null has a null id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import durable
from trailweave.llm.components import components

SEED = 42
#: Shingles whose bits are counted at a time: bounds memory on very long texts.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle_words + 1)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: n - 1]]
    ends = [e - 1 for e in ends[min(shingle_words, len(words)) - 1 :]]
    hashes = (digest(line[s:e], SEED) for s, e in zip(starts, ends))
    return majority(np.fromiter(islice(hashes, BLOCK), np.uint64) for _ in range(0, n, BLOCK))


def majority(parts: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes that come in parts: the bits that over half of them have; zero for none."""
    set_bits, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        set_bits += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[id_col, "fp"])

    rows = df.select(id_col, F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, fp long")


def _blocks(half: Column, n: int) -> list[Column]:
    """A 32-bit value cut into n blocks."""
    cuts = [32 * k // n for k in range(n + 1)]
    return [F.shiftright(half, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:])]


#: Fingerprints that are broadcast, the most frequent first: so many rows of 24 bytes at any scale.
HOT = 1000


def _clear_at(near: Column) -> Callable[[Column], Column]:
    return lambda flip: near.bitwiseAND(flip.bitwiseAND(-flip)) == 0


def _key_of(tag: Column, near: Column, block: Column) -> Callable[[Column], Column]:
    return lambda flip: F.xxhash64(tag, near.bitwiseXOR(flip), block)


def near_links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Distinct pairs (a, b) of the distinct values of ``fp`` that differ in 1 to ``max_bits`` bits."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    table: dict[tuple, Column] = {}
    probes: list[Column] = []
    exact: list[Column] = []
    for name, near, other, radius in (("A", high, low, max_bits // 2), ("B", low, high, (max_bits - 1) // 2)):
        for k in range(radius + 1):
            flips = F.array(*(F.lit(sum(1 << b for b in bits)).cast("long") for bits in combinations(range(32), k)))
            # lowest flipped bit is 0 here, so that one side of each pair asks
            asked = F.filter(flips, _clear_at(near))
            for j, block in enumerate(_blocks(other, max_bits - k + 1)):
                tag = F.lit(f"{name}{max_bits - k + 1}{j}")
                table[name, max_bits - k + 1, j] = F.xxhash64(tag, near, block)
                if k:
                    probes.append(F.transform(asked, _key_of(tag, near, block)))
                else:
                    exact.append(F.xxhash64(tag, near, block))
    held = fps.select(F.col("fp").alias("b"), F.explode(F.array(*table.values())).alias("key"))
    asks = fps.select(F.col("fp").alias("a"), F.lit(True).alias("same"), F.explode(F.array(*exact)).alias("key"))
    if probes:
        asks = asks.union(fps.select("fp", F.lit(False), F.explode(F.flatten(F.array(*probes)))))
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    met = asks.join(held.withColumnRenamed("key", "key_b"), (F.col("key") == F.col("key_b")) & (differ <= max_bits) & (~F.col("same") | (F.col("a") < F.col("b"))))
    return met.select("a", "b").distinct()


def simhash_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2
) -> DataFrame:
    """One row per input row: id, ``fp`` (signed long), ``component_id`` (smallest id reachable by links)."""
    rows = durable(fingerprints(df, id_col, text_col, shingle_words))
    nodes = durable(rows.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count(F.lit(1)).alias("size")))
    roots = components(near_links(nodes.select("fp"), max_bits), "a", "b")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least_id", "size", F.coalesce("root", "fp").alias("group")
    )
    least = rooted.groupBy("group").agg(F.min("least_id").alias("component_id")).withColumnRenamed("group", "g")
    named = durable(rooted.join(least, rooted["group"] == least["g"]).select(F.col("fp").alias("f"), "component_id", "size"))
    # the most frequent fingerprints are sent to all tasks, so the join by fingerprint has no key with over 1 / HOT of all rows
    hot = F.broadcast(named.where("size > 1").orderBy(F.desc("size"), "f").limit(HOT))
    same = F.col("fp") == F.col("f")
    found = rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(named, same))
    return found.select(id_col, "fp", "component_id")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of the input without those whose group has a smaller id; other columns as they are."""
    return without_larger_ids(df, simhash_groups(df, id_col, text_col, shingle_words, max_bits), id_col)


def without_larger_ids(df: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    """The rows of the input whose id is the least of its group (id, .., component_id).

    Rows without an id stay, as nothing tells them apart; an id on several rows goes only if it is the
    smallest of none of their groups.
    """
    each = groups.select(F.col(id_col).alias("i"), F.col("component_id").alias("c")).where("i IS NOT NULL")
    gone = each.groupBy("i").agg(F.bool_or(F.col("i") == F.col("c")).alias("first")).where("NOT first").select("i")
    return df.join(gone, df[id_col] == gone["i"], "left_anti")
