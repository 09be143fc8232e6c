"""Quality rules: an isolation forest over rule statistics.

Every text gets counts of rules (words, symbols, repeated lines, repeated word windows) and ratios
made of them. A forest of random splits is fitted to the ratios of labelled rows: where few random
splits part a row from the others, its path is short and its score high. The score above which a
document is rejected is calibrated on the labelled rows: the lowest one that rejects at most
``max_clean_loss`` of the rows labelled good.

The scale (medians and deviations of the good rows) and the threshold come from all labelled rows, by
Spark. The trees take small random samples each, as the method has it, from at most ``max_labelled``
labelled rows (the smallest hashes of their ids), so the driver's memory is bounded; statistics and verdicts
cover every whole text.

Defined cases: null, empty and white-space-only texts have no words and fail the base rules; labels
without quality are ignored, of labels or documents that repeat an id the least statistics count
once; without labels of both kinds nothing is rejected beyond the base rules; an empty table gives an
empty result. Rows that repeat get the same result each. Other columns stay out (``filtered`` keeps them),
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import durable

WHITESPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Deviations from the median that count for nothing, and that count at most; the least deviation.
SLACK, FAR, LEAST_SPREAD = 4.0, 50.0, 0.005
RATIOS = ("chars_per_word", "symbols_per_word", "bangs_per_word", "dup_line_share", "repeat_share", "stutter_share", "upper_share", "digit_share")


def repeat_words(hashes: np.ndarray, words: list[bytes]) -> int:
    """Words inside windows of 8 words that occur at least twice in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    order = np.sort(mixed)
    if not (order[1:] == order[:-1]).any():
        return 0  # equal windows have equal hashes, so none repeats
    known: dict[bytes, int] = {}
    rank = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    width = 1
    while width < WINDOW:  # ranks of windows twice as wide, from pairs of ranks: exact
        pairs = rank[:-width] * np.int64(len(words) + 1) + rank[width:]
        rank = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        width *= 2
    again = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def rule_statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts and ratios of a whole text, in the order of COUNTS and RATIOS."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at ASCII white space only
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in WHITESPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(WHITESPACE)]
    dup_lines = len(lines) - len(set(lines))
    hashes = np.array([hash(w) for w in words], dtype=np.int64).view(np.uint64)
    repeated = repeat_words(hashes, words)
    codes = np.frombuffer(raw, np.uint8)
    upper = int(((codes >= 65) & (codes <= 90)).sum())
    lower = int(((codes >= 97) & (codes <= 122)).sum())
    digits = int(((codes >= 48) & (codes <= 57)).sum())
    per = max(n, 1)
    ratios = [
        word_chars / per,
        symbols / per,
        text.count("!") / per,
        dup_lines / max(len(lines), 1),
        repeated / per,
        float((hashes[1:] == hashes[:-1]).sum()) / per,
        upper / max(upper + lower, 1),
        digits / max(word_chars, 1),
    ]
    return [n, word_chars, symbols, dup_lines, repeated], ratios


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """The mean path of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees as heaps: children of node i at 2i + 1 and 2i + 2; ``axis`` -1 marks a leaf.

    Rows are put on the scale of the good rows first: how many deviations beyond ``SLACK`` a ratio is
    from their median, ``FAR`` at most. A split takes a ratio with a probability in proportion to its
    range in the node, and a random place in that range.
    """

    middle: np.ndarray
    spread: np.ndarray
    axis: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    sample: int
    threshold: float = np.inf

    @classmethod
    def fit(
        cls, x: np.ndarray, good: np.ndarray, trees: int = 100, sample: int = 64, bad_share: float = 0.05, seed: int = 9,
        scale: tuple[np.ndarray, np.ndarray] | None = None,
    ) -> IsolationForest:
        """From all good rows and so many bad ones that they stay rare in every sample (``bad_share`` of the good).

        ``scale``: medians and deviations, if they come from more rows than ``x``.
        """
        rng = np.random.default_rng(seed)
        normal = x[good] if good.any() else x
        middle, spread = scale or (np.median(normal, axis=0), normal.std(axis=0))
        spread = np.maximum(spread, LEAST_SPREAD)
        bad = rng.permutation(np.flatnonzero(~good))[: max(8, int(bad_share * good.sum()))]
        made = cls(middle, spread, *(np.zeros(0),) * 3, 0)
        x = made.scaled(x[np.concatenate([np.flatnonzero(good), bad])])
        sample = min(sample, len(x))
        depth = max(1, int(np.ceil(np.log2(max(sample, 2)))))
        nodes = 2 ** (depth + 1) - 1
        axis, cut, path = np.full((trees, nodes), -1, np.int16), np.zeros((trees, nodes)), np.zeros((trees, nodes))
        for t in range(trees):
            todo = [(0, 0, rng.choice(len(x), sample, replace=False))]
            while todo:
                node, level, rows = todo.pop()
                low, high = x[rows].min(0), x[rows].max(0)
                reach = (high - low).sum()
                if level == depth or len(rows) < 2 or reach <= 0:
                    path[t, node] = level + float(_mean_path(len(rows)))
                    continue
                k = int(rng.choice(len(low), p=(high - low) / reach))
                at = rng.uniform(low[k], high[k])
                axis[t, node], cut[t, node] = k, at
                left = x[rows, k] < at
                todo += [(2 * node + 1, level + 1, rows[left]), (2 * node + 2, level + 1, rows[~left])]
        made.axis, made.cut, made.path, made.sample = axis, cut, path, sample
        return made

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.abs(x - self.middle) / self.spread - SLACK, 0, FAR)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; short paths score high."""
        x = self.scaled(x)
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for axis, cut, path in zip(self.axis, self.cut, self.path):
            node = np.zeros(len(x), np.int64)
            while (live := axis[node] >= 0).any():
                step = 2 * node + 1 + (x[rows, axis[node]] >= cut[node])
                node = np.where(live, step, node)
            total += path[node]
        return 2.0 ** (-total / len(self.axis) / max(float(_mean_path(self.sample)), 1e-9))


_STAT_FIELDS = ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in RATIOS)


def _statistics(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Of the texts in column 1."""
    found = [rule_statistics(t.as_py()) for t in batch.column(1)]
    counts = np.array([c for c, _ in found], dtype=np.int64).reshape(-1, len(COUNTS))
    return counts, np.array([r for _, r in found], dtype=float).reshape(-1, len(RATIOS))


def _verdicts(counts: np.ndarray, ratios: np.ndarray, forest: IsolationForest | None, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, anomaly score, kept) of each row."""
    failed = (counts[:, 0] < min_words) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
    scores = forest.score(ratios) if forest else np.full(len(counts), np.nan)
    return failed, scores, ~failed & ~(scores > (forest.threshold if forest else np.inf))


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, ratios) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ratios = _statistics(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts.T), *map(pa.array, ratios.T)], names=[id_col, *COUNTS, *RATIOS])

    rows = df.select(id_col, F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {_STAT_FIELDS}")


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], n: int) -> dict[str, list[float]]:
    """The exact values at some places (from 0, in rising order) of columns of ``n`` rows without nulls.

    A sketch of all rows brackets each place; rows below the bracket are counted, and what lies in it is
    counted by value and walked on the driver: a few ten-thousandths of the rows. A bracket that misses is widened.
    """
    off, found = 2e-4, {}
    while todo := {c: r for c, r in ranks.items() if c not in found}:
        share = {c: [float(max(0.0, min(r) / n - off)), float(min(1.0, (max(r) + 1) / n + off))] for c, r in todo.items()}
        brackets = df.agg(*(F.percentile_approx(c, share[c], 10_000).alias(c) for c in todo)).first().asDict()
        below = df.agg(*(F.count_if(F.col(c) < brackets[c][0]).alias(c) for c in todo)).first()
        each = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in todo))).alias("e")).select("e.*")
        inside = F.lit(False)
        for c, (low, high) in brackets.items():
            inside = inside | (F.col("c") == c) & F.col("v").between(low, high)
        held: dict[str, list] = {c: [] for c in todo}
        for r in each.where(inside).groupBy("c", "v").agg(F.count(F.lit(1)).alias("k")).collect():
            held[r.c].append((r.v, r.k))
        for c, wanted in todo.items():
            values = sorted(held[c])
            ends = below[c] + np.cumsum([k for _, k in values], dtype=np.int64)
            if min(wanted) >= below[c] and len(ends) and max(wanted) < ends[-1]:
                found[c] = [values[int(np.searchsorted(ends, w, side="right"))][0] for w in wanted]
        off *= 10
    return found


def _scale(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Medians and deviations of the ratios of ``n`` rows."""
    middles = order_statistics(rows, {c: [(n - 1) // 2, n // 2] for c in RATIOS}, n)
    spread = rows.agg(*(F.stddev_pop(c).alias(c) for c in RATIOS)).first()
    # rounded, as sums of floats depend on the order of rows
    return np.array([np.mean(middles[c]) for c in RATIOS]), np.array([round(spread[c], 9) for c in RATIOS])


def _scores(rows: DataFrame, forest: IsolationForest) -> DataFrame:
    """(score) of rows with ratios."""
    model = rows.sparkSession.sparkContext.broadcast(forest)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"score": model.value.score(f.to_numpy(dtype=float))})

    return rows.select(*RATIOS).mapInPandas(run, "score double")


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
    max_labelled: int = 6000, max_clean_loss: float = 0.0005, seed: int = 9, min_words: int = MIN_WORDS,
) -> IsolationForest | None:
    """The forest, its scale and threshold; None without labelled rows.

    Numbers of all labelled rows are kept, and scale and threshold are taken from all of them; the trees draw
    from at most ``max_labelled``. Texts do not cross: they become numbers where they are.
    """
    named = labels.select(F.col(id_col).alias("l"), F.col(quality_col).cast("int").alias("good"))
    named = named.where("l IS NOT NULL AND good IS NOT NULL").groupBy("l").agg(F.min("good").alias("good"))
    stats = statistics(df, id_col, text_col).withColumnRenamed(id_col, "i")
    least = stats.join(named, F.col("i") == F.col("l")).groupBy("l", "good").agg(F.min(F.struct(*COUNTS, *RATIOS)).alias("s"))
    failed = (F.col("s.n_words") < min_words) | (100 * F.col("s.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("s.n_words"))
    rows = durable(least.where(~failed).select("l", (F.col("good") > 0).alias("good"), *(f"s.{c}" for c in RATIOS)))
    n, n_good = rows.agg(F.count(F.lit(1)), F.count_if("good")).first()
    if not n:
        return None
    drawn = sorted(rows.orderBy(F.xxhash64("l"), "l").limit(max_labelled).collect(), key=lambda r: str((r.l, r.good)))
    normal = rows.where("good") if n_good else rows
    forest = IsolationForest.fit(np.array([[r[c] for c in RATIOS] for r in drawn]), np.array([r.good for r in drawn]), seed=seed, scale=_scale(normal, n_good or n))
    if 0 < n_good < n:
        # rows that score above the threshold are rejected: it is the score of a good row that so many others are above
        forest.threshold = order_statistics(_scores(normal, forest), {"score": [n_good - 1 - int(n_good * max_clean_loss)]}, n_good)["score"][0]
    return forest


def quality_rules(df: DataFrame, forest: IsolationForest | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the counts, ``base_failed``, ``anomaly`` (score; null without a model), ``kept``."""
    model = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = model.value
        for batch in batches:
            counts, ratios = _statistics(batch)
            failed, scores, kept = _verdicts(counts, ratios, forest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, counts.T), pa.array(failed), pa.array(scores, from_pandas=True), pa.array(kept)],
                names=[id_col, *COUNTS, "base_failed", "anomaly", "kept"],
            )

    rows = df.select(id_col, F.col(text_col).alias("_text"))
    kind = df.schema[id_col].dataType.simpleString()
    fields = ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(run, f"`{id_col}` {kind}, {fields}, base_failed boolean, anomaly double, kept boolean")


def filtered(df: DataFrame, forest: IsolationForest | None, text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The rows that are kept, with all their columns; one pass and no shuffle.

    With a smaller ``min_words`` than the query's contract has, short texts are left to the forest.
    """
    model = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = _verdicts(*_statistics(pa.RecordBatch.from_arrays([batch.column(text_col)] * 2, names=["_", "t"])), model.value, min_words)[2]
            yield batch.filter(pa.array(kept))

    return df.mapInArrow(run, df.schema)
