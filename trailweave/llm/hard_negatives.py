"""Hard-negative mining by bit-sliced integer products.

Vectors of integers are kept as bit-planes (two's complement, one bit of every component per plane). A
score is the sum of the planes' inner products with the anchor, each times its power of two; planes are
taken most significant first. After some planes a score is known up to what the planes left can
add: at most (2^t - 1) times the anchor's positive components, at least (2^t - 1) times its negative ones,
for t planes left. So every score has an interval that gets tighter with each plane, and a
row is dropped once its interval cannot reach a window of wanted scores, or lies below as many rows as
are asked for that are surely inside. The first planes are taken for all rows at once; as soon as few rows
are left, the others are taken for those alone. What is left in the end has exact scores.

Shape: every anchor has to meet all rows. Rows are dealt to buckets of about ``bucket_rows``, and anchors, which are
few, are sent to each; a task holds the rows of one bucket, and anchors stream past them in batches. So memory
is bounded by the bucket and the batch, nothing goes through the driver but three numbers, and
no key holds more than its bucket. Each bucket sends on at most as many rows per anchor as are asked for,
which are then merged by anchor. Two such passes: one for positives, one for negatives.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component (``scaled`` makes
them null vectors) take no part; a shorter vector ends in zeros; ids that repeat are rows of their own, an
anchor's own row is no positive of it but another row of its id may be; an empty table gives an empty result.
Scores that could pass 2^53 are an error. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailweave.llm.common import durable

#: Anchors and rows of one block of scores; share of a block below which rows go on one by one.
ANCHORS, ROWS, FEW = 128, 8192, 0.08


def scaled(col: str, by: float) -> Column:
    """floor(by * x) of every component; null where the vector is, or any component is null or not finite."""
    wide = F.transform(col, lambda x: x.cast("double"))
    ok = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(ok, F.transform(wide, lambda x: F.floor(x * F.lit(float(by)))))


@dataclass(frozen=True)
class Planes:
    """How vectors are packed: components, and bits of each with its sign."""

    width: int
    bits: int

    def pack(self, values: np.ndarray) -> np.ndarray:
        """int64 (n, width) -> bytes (n, bits * stride), the most significant plane first."""
        shifts = np.arange(self.bits - 1, -1, -1)
        planes = (values[:, None, :] >> shifts[None, :, None]) & 1
        return np.packbits(planes.astype(np.uint8), axis=2).reshape(len(values), -1)

    def unpack(self, packed: np.ndarray) -> np.ndarray:
        """bytes (n, bits * stride) -> 0 and 1, (bits, n, width)."""
        stride = -(-self.width // 8)
        return np.unpackbits(packed.reshape(len(packed), self.bits, stride), axis=2, count=self.width).transpose(1, 0, 2)

    def weights(self) -> np.ndarray:
        """Of the planes: the first is the sign's."""
        w = 2.0 ** np.arange(self.bits - 1, -1, -1)
        w[0] = -w[0]
        return w

    def values(self, packed: np.ndarray) -> np.ndarray:
        return np.tensordot(self.weights(), self.unpack(packed).astype(np.float64), 1)


def kept_pairs(anchors: np.ndarray, planes: list[np.ndarray], weights: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, most: int, able: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, exact score) of the pairs that may be among the ``most`` highest scores of a window.

    ``low``, ``high``, ``floor``: (anchors, windows) bounds, and scores that so many rows reached before.
    ``able`` tells which pairs count. Pairs in no window are dropped, as are those that ``most`` others of
    each of their windows surely exceed.
    """
    bits, floor = len(planes), floor.copy()
    up, down = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
    known = np.zeros((len(anchors), len(planes[0])))
    alive = np.ones(known.shape, bool) if able is None else able.copy()
    pairs = None
    for k in range(bits):
        rest = 2.0 ** (bits - 1 - k) - 1
        if pairs is None:
            known += weights[k] * (anchors @ planes[k].T)
            some = known[:, ::16]
            if (rest * (up - down) > some.max(1) - some.min(1)).all():
                continue  # hardly any can be dropped yet
            least, greatest = known + (rest * down)[:, None], known + (rest * up)[:, None]
            if most <= known.shape[1]:
                for w in range(low.shape[1]):
                    sure = np.where(alive & (least >= low[:, w, None]) & (greatest <= high[:, w, None]), least, -np.inf)
                    floor[:, w] = np.maximum(floor[:, w], np.partition(sure, -most, axis=1)[:, -most])
            inside = np.zeros(known.shape, bool)
            for w in range(low.shape[1]):
                inside |= (greatest >= np.maximum(low[:, w], floor[:, w])[:, None]) & (least <= high[:, w, None])
            alive &= inside
            if alive.sum() <= FEW * alive.size or k == bits - 1:
                pairs = np.nonzero(alive)
                score = known[pairs]
        elif len(score):
            a, r = pairs
            score += weights[k] * np.einsum("ij,ij->i", anchors[a], planes[k][r])
            inside = ((score + rest * up[a])[:, None] >= np.maximum(low, floor)[a]) & ((score + rest * down[a])[:, None] <= high[a])
            ok = inside.any(1)
            pairs, score = (a[ok], r[ok]), score[ok]
    return pairs[0], pairs[1], score


class _Best:
    """The highest scores of every (anchor, window), ties by smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, most: int):
        self.low, self.high, self.most = low, high, most
        self.floor = np.full(low.shape, -np.inf)
        self.found: list[list[tuple[np.ndarray, np.ndarray]]] = [[(np.zeros(0), np.zeros(0, np.int64))] * low.shape[1] for _ in low]

    def add(self, anchor: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        order = np.argsort(anchor, kind="stable")
        anchor, ids, score = anchor[order], ids[order], score[order]
        names, starts = np.unique(anchor, return_index=True)
        for a, lo, hi in zip(names, starts, np.append(starts[1:], len(anchor))):
            for w in range(self.low.shape[1]):
                ok = (score[lo:hi] >= self.low[a, w]) & (score[lo:hi] <= self.high[a, w]) & (score[lo:hi] >= self.floor[a, w])
                if ok.any():
                    s, i = (np.concatenate(x) for x in zip(self.found[a][w], (score[lo:hi][ok], ids[lo:hi][ok])))
                    best = np.lexsort((i, -s))[: self.most]
                    self.found[a][w] = s[best], i[best]
                    if len(best) == self.most:
                        self.floor[a, w] = s[best[-1]]


def best_of_bucket(shape: Planes, rows: tuple[np.ndarray, np.ndarray, list[np.ndarray]], anchors: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, most: int, same: bool) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For every anchor and window the best (scores, ids) among rows (ids, labels, planes) of its label, or of others."""
    ids, row_labels, planes = rows
    best, weights = _Best(low, high, most), shape.weights()
    for start in range(0, len(ids), ROWS):
        part = slice(start, start + ROWS)
        mask = row_labels[part][None, :] == labels[:, None]
        if not same:
            mask = ~mask
        a, r, score = kept_pairs(anchors, [p[part].astype(np.float64) for p in planes], weights, low, high, best.floor, most, mask)
        best.add(a, ids[part][r], score)
    return best.found


def _passed(rows: DataFrame, anchors: DataFrame, shape: Planes, buckets: int, most: int, same: bool) -> DataFrame:
    """(uid, window, score, id): each bucket's best rows of every anchor and window."""
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    none = F.lit(None).cast("array<double>")
    left = rows.select(deal.alias("bucket"), F.lit(False).alias("is_anchor"), F.lit(None).cast("long").alias("uid"), "id", "label", "planes", none.alias("low"), none.alias("high"))
    right = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(True).alias("is_anchor"), "uid", F.col("id"), "label", "planes", "low", "high")
    dealt = left.unionByName(right).repartition(buckets, "bucket").sortWithinPartitions("bucket", "is_anchor")

    def table(batch: pa.RecordBatch, part: slice) -> np.ndarray:
        made = batch.column(5)[part.start : part.stop]
        return np.frombuffer(b"".join(made.to_pylist()), np.uint8).reshape(len(made), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, rows = None, [], None
        for batch in batches:
            kinds = np.column_stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)])
            borders = np.flatnonzero((kinds[1:] != kinds[:-1]).any(1)) + 1
            for start, stop in zip([0, *borders], [*borders, len(kinds)]):
                if start == stop:
                    continue
                if kinds[start, 0] != bucket:
                    bucket, held, rows = kinds[start, 0], [], None
                if not kinds[start, 1]:
                    held.append((*(batch.column(k)[start:stop].to_numpy(zero_copy_only=False) for k in (3, 4)), table(batch, slice(start, stop))))
                    continue
                if rows is None and held:
                    ids, labels, packed = (np.concatenate(x) for x in zip(*held))
                    rows, held = (ids, labels, list(np.ascontiguousarray(shape.unpack(packed)))), []
                if rows is None:
                    continue
                for at in range(start, stop, ANCHORS):
                    part = slice(at, min(stop, at + ANCHORS))
                    uid, labels = (batch.column(k)[part.start : part.stop].to_numpy(zero_copy_only=False) for k in (2, 4))
                    low, high = (batch.column(k)[part.start : part.stop].to_pylist() for k in (6, 7))
                    windows = max(map(len, low))
                    pad = lambda x, v: np.array([[*r, *[v] * (windows - len(r))] for r in x], dtype=float).reshape(len(x), windows)
                    found = best_of_bucket(shape, rows, shape.values(table(batch, part)), labels, pad(low, np.inf), pad(high, -np.inf), most, same)
                    out = [(u, w, s, i) for u, ws in zip(uid, found) for w, (ss, ii) in enumerate(ws) for s, i in zip(ss, ii)]
                    if out:
                        u, w, s, i = zip(*out)
                        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(w, pa.int32()), pa.array(np.array(s).astype(np.int64)), pa.array(i, pa.int64())], names=["uid", "window", "score", "id"])

    return dealt.mapInArrow(run, "uid long, window int, score long, id long")


def _packed(vectors: DataFrame, shape: Planes) -> DataFrame:
    """The same rows with their vectors as planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            values = np.zeros((batch.num_rows, shape.width), np.int64)
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            values[row, column] = lists.flatten().to_numpy(zero_copy_only=False)
            planes = [p.tobytes() for p in shape.pack(values)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(planes, pa.binary())], names=["id", "label", "own", "planes"])

    return vectors.select("id", "label", "own", "vector").mapInArrow(run, "id long, label long, own long, planes binary")


def hard_negatives(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector",
    positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), bucket_rows: int = 200_000,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are the ``positives`` other rows of its label with the highest scores; a positive's
    negatives are the ``negatives`` rows of other labels with the highest scores between the two
    percentages of the positive's score. Ties go to smaller ids.
    """
    fields = [F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"), F.col(vector_col).cast("array<long>").alias("vector")]
    vectors = df.select(fields).where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    size = vectors.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    width, largest = max(1, size[1] or 1), max(1, size[2] or 1)
    if width * largest * largest >= 2**53:
        raise ValueError(f"scores of {width} components up to {largest} could pass 2^53")
    shape = Planes(width, int(largest).bit_length() + 1)
    buckets = max(1, -(-size[0] // bucket_rows), min(32, -(-size[0] // 2000)))
    vectors = vectors.withColumn("own", F.aggregate("vector", F.lit(0).cast("long"), lambda a, x: a + x * x))
    rows = _packed(vectors, shape)
    anchors = durable(_packed(vectors.where("is_anchor"), shape).withColumn("uid", F.monotonically_increasing_id()))

    def ranked(found: DataFrame, most: int) -> DataFrame:
        order = Window.partitionBy("uid", "window").orderBy(F.col("score").desc(), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    # an anchor is among the rows of its label: one more is asked for, and one with its id and its own score goes
    all_scores = anchors.withColumns({c: F.array(F.lit(x)) for c, x in (("low", float("-inf")), ("high", float("inf")))})
    near = ranked(_passed(rows, all_scores, shape, buckets, positives + 1, same=True), positives + 1)
    lists = near.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("rank", "score", F.col("id").alias("of")))).alias("near"))
    itself = F.array_position(F.transform("near", lambda n: (n["of"] == F.col("id")) & (n["score"] == F.col("own"))), True)
    found = anchors.join(lists, "uid").withColumn("itself", itself)
    found = found.withColumn("near", F.slice(F.filter("near", lambda n, k: k + 1 != F.col("itself")), 1, positives)).where(F.size("near") > 0)
    down = lambda y: (y - F.pmod(y, F.lit(100))) / F.lit(100)
    low = F.transform("near", lambda n: -down(-n["score"] * window[0]))
    high = F.transform("near", lambda n: down(n["score"] * window[1]))
    found = durable(found.withColumns({"low": low, "high": high}))
    best = ranked(_passed(rows, found, shape, buckets, negatives, same=False), negatives).select("uid", "window", "rank", "score", F.col("id").alias("negative_id"))
    positive = F.get("near", F.col("window"))
    return best.join(found, "uid").select(
        F.col("id").alias("anchor_id"), positive["of"].alias("positive_id"), "rank", "negative_id", positive["score"].alias("positive_score"), F.col("score").alias("negative_score")
    )
