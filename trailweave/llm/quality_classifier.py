"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

A text's words and its runs of other signs are hashed with their neighbours into ``2 ** BITS`` buckets
(unigrams and bigrams; a word that follows itself, or itself and one other, is an event of its own, whatever the word). A bucket that
occurs n times weighs log(1 + n), and a text's weights are scaled to length one, so long and short texts
compare. The score is the logistic function of a sparse dot product with the weights.

Fitting: the features of at most ``max_labelled`` labelled documents (the smallest hashes of their ids) are
made by Spark and collected, sparse, so what reaches the driver is bounded by that parameter; the updates
follow each other by definition. Every text is read whole, in fitting and in scoring; scoring is one pass
without a shuffle.

Defined cases: null and empty texts have no features and get the score of the bias alone; labels without
an id or a quality are ignored; of labels that repeat an id the least counts, of documents that repeat one
the least features; a row without an id is scored and not held out; without labels every score is 0.5; an empty table
gives an empty result. Rows that repeat get the same score each. Other columns stay out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BITS = 20
TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX, _PAIR, _SAME, _AGAIN = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def ngram_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets ascending, weights) of a whole text."""
    tokens = TOKEN.findall(text or "")
    h = np.fromiter((crc32(t.encode("utf-8", "surrogatepass")) for t in tokens), np.uint64, len(tokens)) * _MIX
    pairs = np.where(h[1:] == h[:-1], _SAME, (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _PAIR + h[1:]) * _MIX
    again = np.full(int((h[2:] == h[:-2]).sum()), _AGAIN)
    buckets, counts = np.unique(np.concatenate([h, pairs, again]) >> np.uint64(64 - BITS), return_counts=True)
    weights = np.log1p(counts)
    return buckets.astype(np.int32), (weights / max(float(np.sqrt(weights @ weights)), 1e-12)).astype(np.float32)


def sigmoid(x: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Ftrl:
    """Weights by coordinate from the sums of gradients ``z`` and of their squares ``n``; the last is the bias.

    A weight whose \\|z\\| is below ``l1`` is zero, so buckets that say little cost nothing.
    """

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.0
    z: np.ndarray = field(default_factory=lambda: np.zeros(2**BITS + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros(2**BITS + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> float:
        """One update; returns the probability before it. The bias stands in ``at`` like any bucket."""
        w = self.weights(at)
        p = float(sigmoid(w @ x))
        g = (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return p


def trained(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, seed: int = 13) -> np.ndarray:
    """Weights from (buckets, values, label) rows, taken in a new order each time."""
    model, rng = Ftrl(), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x, label = rows[k]
            model.learn(np.append(at, 2**BITS), np.append(x, 1.0), float(label))
    return model.weights().astype(np.float32)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: by its id alone."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", max_labelled: int = 8000) -> np.ndarray:
    """Weights from at most ``max_labelled`` of the labelled documents that are not held out."""
    named = labels.where(~held_out(id_col)).select(F.col(id_col).alias("l"), (F.col(quality_col) > 0).cast("int").alias("good"))
    chosen = named.where("l IS NOT NULL AND good IS NOT NULL").groupBy("l").agg(F.min("good").alias("good")).orderBy(F.xxhash64("l"), "l").limit(max_labelled)
    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), F.col("i") == F.col("l"))
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [ngram_features(t.as_py()) for t in batch.column(2)]
            at, x = ([m[k].tobytes() for m in made] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(x, pa.binary())], names=["l", "good", "at", "x"])

    made = rows.select("l", "good", "t").mapInArrow(run, f"l {kind.simpleString()}, good int, at binary, x binary")
    found = made.groupBy("l", "good").agg(F.min(F.struct("at", "x")).alias("f")).orderBy(F.xxhash64("l"), "l").collect()
    return trained([(np.frombuffer(r.f.at, np.int32), np.frombuffer(r.f.x, np.float32), r.good) for r in found])


def scored(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row; 1 where the score is 0.5 at least."""
    model = df.sparkSession.sparkContext.broadcast(weights)
    kind = df.schema[id_col].dataType
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            dots = np.array([float(w[at] @ x) for at, x in (ngram_features(t.as_py()) for t in batch.column(1))], dtype=float)
            p = sigmoid(dots + float(w[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], schema=schema)

    return df.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, score double, predicted int")
