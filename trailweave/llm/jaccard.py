"""Near copies by the Jaccard similarity of word shingles: SimHash and MinHash find candidates, the sets themselves decide.

Two texts link if their sets of ``SHINGLE_WORDS``-word shingles have a similarity of 0.8 at least. Candidates are

* pairs whose SimHash fingerprints differ in ``simhash.near_links``'s two bits at most (multi-index hashing);
* what these can't reach, as texts of similarity 0.8 differ in some ten of 64 bits: sets that share one of
  ``BANDS`` MinHash keys, each made of ``ROWS`` minima under random permutations. A pair of similarity s shares
  none with chance (1 - s ** ROWS) ** BANDS: 5 in 100,000 at 0.8, less above.

What a set has in common with others can't be more than its shingles that occur in another set at all; where
these are too few, nothing is compared. All other candidates that a link could still add something to are
compared exactly:

* first each member of a bucket with one node of the bucket, which is linear in the bucket and gives the
  members of one group one centre;
* then, in buckets whose members have several centres, all pairs across centres. No bucket is capped.

Texts with the same set are one node, so copies cost nothing. A shingle is a 64-bit hash.

Defined cases: null, empty and white-space-only texts have the empty set and link with each other only;
texts shorter than a shingle are one shingle; ASCII case and white space don't count; rows that repeat
get the same group; an empty table gives an empty result; other columns stay (``near_dedup``), whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import durable, whole_text
from trailweave.llm.components import components
from trailweave.llm.simhash import majority, near_links, without_larger_ids

SHINGLE_WORDS = 5
BANDS, ROWS = 25, 5
SEED = 42
#: A shingle in so many nodes or fewer is one by which nodes meet in the last turn.
RARE = 12
#: Shingles permuted at a time: bounds memory on very long texts.
BLOCK = 1 << 10
_DRAWS = np.random.default_rng(SEED).integers(0, 1 << 64, (3, BANDS * ROWS), dtype=np.uint64)
_FLIP, _FACTOR, _MIX = _DRAWS[0], _DRAWS[1] | np.uint64(1), (_DRAWS[2] | np.uint64(1)).reshape(BANDS, ROWS)


def digests(text: str | None, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return np.empty(0, np.uint64)
    n, line, digest = max(1, len(words) - words_each + 1), b" ".join(words), xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: n - 1]]
    return np.array([digest(line[s : e - 1], SEED) for s, e in zip(starts, ends[min(words_each, len(words)) - 1 :])], dtype=np.uint64)


def shingles(text: str | None, words_each: int = SHINGLE_WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(digests(text, words_each))


def band_keys(found: np.ndarray) -> np.ndarray:
    """The keys under which a set is looked up, none for the empty set."""
    if not len(found):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), BLOCK):
        least = np.minimum(least, ((found[at : at + BLOCK, None] ^ _FLIP) * _FACTOR).min(axis=0))
    least ^= least >> np.uint64(32)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a similarity of 0.8 at least."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, r1, r2, text): r1 and r2 are hashes by which a row's text is found again."""
    text = whole_text(text_col)
    return df.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text).alias("r1"), F.xxhash64(F.lit(1), id_col, text).alias("r2"), F.col(text_col).alias("text"))


def _signed(rows: DataFrame, id_type: str) -> DataFrame:
    """(id, r1, r2, digest, fp, n, keys) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, fp, n, keys = [], [], [], []
            for cell in batch.column(3):
                each = digests(cell.as_py())
                found = np.unique(each)
                fp.append(majority([each]))
                digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                n.append(len(found))
                keys.append(band_keys(found))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(digest, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "r1", "r2", "digest", "fp", "n", "keys"],
            )

    return rows.mapInArrow(run, f"id {id_type}, r1 long, r2 long, digest binary, fp long, n long, keys array<long>")


def _sets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, found) with the shingle hashes of each of ``nodes`` (node, r1, r2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py()).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "found"])

    texts = rows.withColumnsRenamed({"r1": "s1", "r2": "s2"}).join(nodes, (F.col("r1") == F.col("s1")) & (F.col("r2") == F.col("s2")))
    # Rows that repeat id and text have the same set.
    return texts.select("node", "text").mapInArrow(run, "node long, found array<long>").dropDuplicates(["node"])


def _counted(sets: DataFrame) -> DataFrame:
    """(node, x, c): the shingles that occur in c > 1 of the nodes."""
    each = sets.select("node", F.explode("found").alias("x"))
    often = each.groupBy("x").agg(F.count(F.lit(1)).alias("c")).where("c > 1").withColumnRenamed("x", "y")
    return each.join(often, F.col("x") == F.col("y")).select("node", "x", "c")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b, o) that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(batch.column(3), batch.column(4))
            same = [alike(*(x.values.to_numpy() for x in pair)) for pair in cells]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(same, pa.bool_())) for k in range(3)], names=["a", "b", "o"])

    one, other = (sets.select(F.col("node").alias(f"n{c}"), F.col("found").alias(f"set_{c}")) for c in "ab")
    met = durable(pairs).join(other, F.col("b") == F.col("nb")).join(one, F.col("a") == F.col("na"))
    return met.select("a", "b", "o", "set_a", "set_b").mapInArrow(run, "a long, b long, o long")


def _may_be_alike(n: Column, e: Column, m: Column, f: Column) -> Column:
    """Sets of n and m shingles, of which e and f are in any other set, can't have more than these in common."""
    return 9 * F.least(e, f) >= 4 * (n + m)


def _to_centre(held: DataFrame) -> DataFrame:
    """(a, b, o): the members of each bucket, and as b the one that is most like all, o being how much, the less the more."""
    centre = held.groupBy("key").agg(F.min(F.struct((-F.col("h")).alias("o"), "node", "n", "e")).alias("c")).withColumnRenamed("key", "k")
    met = held.join(centre, (F.col("key") == F.col("k")) & (F.col("node") != F.col("c.node")) & _may_be_alike(F.col("n"), F.col("e"), F.col("c.n"), F.col("c.e")))
    return met.select(F.col("node").alias("a"), F.col("c.node").alias("b"), F.col("c.o").alias("o")).distinct()


def _mixed(held: DataFrame, links: DataFrame) -> DataFrame:
    """(key, node, n, e, h, root) in the buckets whose members have several centres; root is a node's best centre or itself."""
    best = links.where("o IS NOT NULL").groupBy(F.col("a").alias("m")).agg(F.min(F.struct("o", "b")).alias("c"))
    rooted = held.join(best, F.col("node") == F.col("m"), "left").select("key", "node", "n", "e", "h", F.coalesce("c.b", "node").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(F.col("key").alias("k"))
    return durable(rooted.join(mixed, F.col("key") == F.col("k"), "left_semi"))


def _across(mixed: DataFrame, counted: DataFrame) -> DataFrame:
    """All pairs of nodes that share a bucket but no centre, and can be alike.

    Two sets share a shingle that few nodes have, by which they meet, or only such that many have.
    """

    def twice(left: DataFrame, by: str, shared: str) -> DataFrame:
        other = left.select(*(F.col(c).alias(f"{c}_b") for c in left.columns))
        may = _may_be_alike(F.col("n"), F.col(shared), F.col("n_b"), F.col(f"{shared}_b"))
        met = left.join(other, (F.col(by) == F.col(f"{by}_b")) & (F.col("root") < F.col("root_b")) & may)
        return met.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"), F.lit(None).cast("long").alias("o"))

    nodes = mixed.select("node", "n", "e", "root").distinct()
    rare = counted.where(F.col("c") <= RARE).select(F.col("node").alias("m"), "x")
    return twice(mixed, "key", "h").union(twice(nodes.join(rare, F.col("node") == F.col("m")).drop("m"), "x", "e")).distinct()


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b, o): nodes with one fingerprint, each with the least of them, and the least ones of near fingerprints."""
    least = nodes.groupBy("fp").agg(F.min("node").alias("least")).withColumnRenamed("fp", "f")
    same = nodes.join(least, (F.col("fp") == F.col("f")) & (F.col("node") != F.col("least"))).select(F.col("node").alias("a"), F.col("least").alias("b"))
    near = near_links(least.select(F.col("f").alias("fp")))
    one, other = least.toDF("fa", "na"), least.toDF("fb", "nb")
    far = near.join(one, F.col("a") == F.col("fa")).join(other, F.col("b") == F.col("fb")).select(F.col("na").alias("a"), F.col("nb").alias("b"))
    return same.union(far).withColumn("o", F.lit(None).cast("long"))


def near_copy_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id) of every row; component_id is the smallest id reachable by links."""
    rows = _rows(df, id_col, text_col)
    signed = durable(_signed(rows, df.schema[id_col].dataType.simpleString()))
    sets = signed.groupBy("digest").agg(F.min("id").alias("least_id"), F.min(F.struct("r1", "r2")).alias("r"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = durable(sets.select(F.monotonically_increasing_id().alias("node"), "digest", "least_id", "r.r1", "r.r2", "fp", "n", "keys"))
    held = nodes.select("node", "n", F.explode("keys").alias("key"))
    met = held.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("key").alias("k"))
    held = durable(held.join(met, F.col("key") == F.col("k"), "left_semi"))
    pairs = durable(_by_fingerprint(nodes.select("node", "fp")))
    wanted = held.select("node").union(pairs.select("a")).union(pairs.select("b")).distinct().withColumnRenamed("node", "w")
    found = durable(_sets(rows, nodes.join(wanted, F.col("node") == F.col("w")).select("node", "r1", "r2")))
    counted = _counted(found)
    shared = counted.groupBy(F.col("node").alias("m")).agg(F.count(F.lit(1)).alias("e"), F.count_if(F.col("c") > RARE).alias("h"))
    held = durable(held.join(shared, (F.col("node") == F.col("m")) & (5 * F.col("e") >= 4 * F.col("n"))).select("key", "node", "n", "e", "h"))
    near = durable(_verified(_to_centre(held).union(pairs), found))
    rest = durable(_verified(_across(_mixed(held, near), counted), found))
    roots = components(near.union(rest), "a", "b").withColumnRenamed("node", "m")
    rooted = nodes.join(roots, F.col("node") == F.col("m"), "left").select("digest", "least_id", F.coalesce("root", "node").alias("group"))
    least = rooted.groupBy("group").agg(F.min("least_id").alias("component_id")).withColumnRenamed("group", "g")
    named = rooted.join(least, F.col("group") == F.col("g")).select(F.col("digest").alias("d"), "component_id")
    return signed.join(named, F.col("digest") == F.col("d")).select(F.col("id").alias(id_col), "component_id")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of the input without those whose group has a smaller id; other columns as they are."""
    return without_larger_ids(df, near_copy_groups(df, id_col, text_col), id_col)
