"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its subwords (the byte n-grams of each marked word, hashed
into a fixed number of buckets), and a linear layer over that mean gives one logit per
language. Both are trained by stochastic gradient descent in numpy, on whole documents and on random
short spans of them, so that short texts are known too. A temperature and the score below which a
prediction is rejected are calibrated on documents that were left out of training, and on scrambled
spans of theirs, which are text of no language.

Embedding and layer are multiplied out once per bucket after training, so predicting a text adds up a
few numbers per word; words are remembered per worker within a bound.

The model is fitted on the driver to a bounded sample: about ``per_language`` pieces a language, or
``in_all`` over all languages if these are more. Pieces are whole documents, or parts of ``longest`` characters
of longer ones, any of which its hash may choose. Predictions cover every whole text and see
the text alone.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and not accepted; where
there is nothing to learn from, all are; ties go to the language first in sorted order; an empty table
gives an empty result; other columns stay out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
BUCKETS = 1 << 16
DIMENSIONS = 16
GRAMS = (2, 3, 4)
#: Longer words are cut into parts of this many characters.
WORD_PART = 40
WORDS_KEPT = 300_000


def words_of(text: str) -> list[str]:
    """Lower-case words, overlong ones in parts."""
    found = text.lower().split()
    if any(len(w) > WORD_PART for w in found):
        found = [w[k : k + WORD_PART] for w in found for k in range(0, len(w), WORD_PART)]
    return found


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket): the hashed byte n-grams of each marked word, and the word itself, for many words at once."""
    raw = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    number, end = np.repeat(np.arange(len(raw)), sizes), np.repeat(np.cumsum(sizes), sizes)
    word, bucket = [np.arange(len(raw))], [np.array([zlib.crc32(r) % BUCKETS for r in raw], dtype=np.int64)]
    code = data
    for n in range(2, GRAMS[-1] + 1):
        code = code[:-1] | data[n - 1 :] << np.uint64(8 * (n - 1))
        if n in GRAMS:
            inside = np.flatnonzero(np.arange(n, n + len(code)) <= end[: len(code)])
            mixed = (code[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            word.append(number[inside])
            bucket.append(((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(word), np.concatenate(bucket)


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter."""
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """``scores`` holds, per bucket, the logits its embedding adds; ``rejected_below`` a calibrated score."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    rejected_below: float = 0.0

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


class Predictor:
    """A model with a bounded memory of words, in two generations; one per Python worker."""

    def __init__(self, model: Model):
        self.model = model
        self._begin()
        self.old_row, self.old_sums = {}, self.sums

    def _begin(self) -> None:
        self.row: dict[str, int] = {}
        self.sums = np.zeros((4096, len(self.model.languages) + 1))

    def _learn(self, words: list[str]) -> None:
        """Add words to the young generation: what they add to the logits, and their numbers of subwords."""
        first, n = len(self.row), len(self.row) + len(words)
        while n > len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.row.update(zip(words, range(first, n)))
        known = [k for k, w in enumerate(words) if w in self.old_row]
        if known:
            self.sums[[first + k for k in known]] = self.old_sums[[self.old_row[words[k]] for k in known]]
        fresh = [k for k, w in enumerate(words) if w not in self.old_row]
        if fresh:
            word, bucket = subwords([words[k] for k in fresh])
            at = [first + k for k in fresh]
            for lang, scores in enumerate(self.model.scores.T):
                self.sums[at, lang] = np.bincount(word, scores[bucket], len(fresh))
            self.sums[at, -1] = np.bincount(word, minlength=len(fresh))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated score, whether the score passes the rejection threshold)."""
        if not self.model.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        words, total = words_of(text), np.zeros(self.sums.shape[1])
        for at in range(0, len(words), 1 << 16):
            part = words[at : at + (1 << 16)]
            if len(self.row) > WORDS_KEPT:
                self.old_row, self.old_sums = self.row, self.sums
                self._begin()
            rows = list(map(self.row.get, part))
            if None in rows:
                self._learn(list(dict.fromkeys(w for w, r in zip(part, rows) if r is None)))
                rows = list(map(self.row.__getitem__, part))
            total += self.sums[rows].sum(0)
        p = self.model.probabilities(total[:-1] / max(total[-1], 1) + self.model.bias)
        best = int(p.argmax())
        return self.model.languages[best], float(p[best]), bool(p[best] >= self.model.rejected_below)


def _counted(words: list[str], known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of some words and their shares."""
    fresh = list(dict.fromkeys(w for w in words if w not in known))
    if fresh:
        word, bucket = subwords(fresh)
        parts = np.split(bucket[np.argsort(word, kind="stable")], np.cumsum(np.bincount(word, minlength=len(fresh)))[:-1])
        known.update(zip(fresh, parts))
    ids, n = np.unique(np.concatenate([known[w] for w in words]), return_counts=True)
    return ids, (n / n.sum()).astype(np.float32)


def folded(names: list[str], embed: np.ndarray, layer: np.ndarray, bias: np.ndarray) -> Model:
    """A model whose embeddings and layer are multiplied out."""
    return Model(names, (embed @ layer.T).astype(np.float64), bias.astype(np.float64))


#: Samples of a step.
STEP_SAMPLES = 16


def train(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.6, held: float = 0.2, seed: int = 3) -> Model:
    """Fit, then calibrate on the ``held`` share of the texts."""
    pairs = [(words_of(t), y) for t, y in zip(texts, langs) if has_letter(t)]
    names = sorted({y for _, y in pairs})
    if not names:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(pairs))
    apart = set(order[: int(held * len(pairs))].tolist()) if len(pairs) >= 20 else set()
    known: dict[str, np.ndarray] = {}
    target = {y: k for k, y in enumerate(names)}

    def span(words: list[str]) -> list[str]:
        n = min(len(words), int(rng.integers(3, 40)))
        at = int(rng.integers(0, len(words) - n + 1))
        return words[at : at + n]

    embed = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    layer = np.zeros((len(names), DIMENSIONS), np.float32)
    bias = np.zeros(len(names), np.float32)
    mine = [k for k in range(len(pairs)) if k not in apart]
    steps, done = 2 * epochs * len(mine), 0
    for epoch in range(epochs):
        samples = []
        for k in rng.permutation(mine):
            words, y = pairs[k]
            samples += [(s, target[y]) for s in ((words, span(words)) if epoch == 0 else (span(words), span(words)))]
        for at in range(0, len(samples), STEP_SAMPLES):
            part = samples[at : at + STEP_SAMPLES]
            _step(embed, layer, bias, [_counted(w, known) for w, _ in part], np.array([y for _, y in part]), np.float32(rate * (1 - done / steps)))
            done += len(part)
    model = folded(names, embed, layer, bias)
    samples = [(s, target[y]) for k in sorted(apart) for words, y in [pairs[k]] for s in (words, span(words), span(words))]
    noise = [(_scrambled(span(pairs[k][0]), rng), -1) for k in sorted(apart)]
    _calibrate(model, samples, noise, known)
    return model


def _step(embed: np.ndarray, layer: np.ndarray, bias: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, pace: np.float32) -> None:
    """One step of gradient descent on some samples (distinct buckets, their shares), in place."""
    sizes = np.array([len(ids) for ids, _ in bags])
    ids, share = np.concatenate([i for i, _ in bags]), np.concatenate([s for _, s in bags])
    of = np.repeat(np.arange(len(bags)), sizes)
    mean = np.add.reduceat(embed[ids] * share[:, None], np.cumsum(sizes) - sizes)
    z = mean @ layer.T + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    back = (p @ layer) * np.sqrt(sizes)[:, None].astype(np.float32)
    layer -= pace * (p.T @ mean)
    bias -= pace * np.float32(0.1) * p.sum(axis=0)
    np.subtract.at(embed, ids, pace * share[:, None] * back[of])


def _scrambled(words: list[str], rng: np.random.Generator) -> list[str]:
    """Words of the same lengths from the same characters in random order: text of no language."""
    chars = np.array(list("".join(words)))
    rng.shuffle(chars)
    cuts = np.cumsum([len(w) for w in words])[:-1]
    return ["".join(part) for part in np.split(chars, cuts)]


def _calibrate(model: Model, samples: list, noise: list, known: dict, wanted: float = 0.98) -> None:
    """Temperature of least loss on the samples; then, with the noise counted as errors, the lowest
    threshold whose accepted predictions are right ``wanted`` of the time."""
    if not samples:
        return

    def logits(rows: list) -> np.ndarray:
        return np.array([share @ model.scores[ids] + model.bias for ids, share in (_counted(w, known) for w, _ in rows)])

    z, y = logits(samples), np.array([k for _, k in samples])
    losses = []
    for t in np.geomspace(0.3, 8, 60):
        model.temperature = float(t)
        losses.append((-np.log(np.maximum(model.probabilities(z)[np.arange(len(y)), y], 1e-12)).mean(), float(t)))
    model.temperature = min(losses)[1]
    p, y = model.probabilities(np.concatenate([z, logits(noise)])), np.concatenate([y, np.full(len(noise), -1)])
    best, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-best, kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(precision >= wanted)
    model.rejected_below = float(best[order][fine[-1]]) if len(fine) else 1.0


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_language: int = 1000, in_all: int = 8000, longest: int = 4000, seed: int = 3,
) -> Model:
    """Learn from the documents that are not held out.

    Whole texts are cut into pieces of ``longest`` characters at most, and each piece is chosen by its hash: so every part of
    every document is as likely to be learned from, long ones by more pieces, and what reaches the driver is
    at most 2 * ``in_all`` pieces, whatever the number of languages and documents. Two scans: languages and
    their numbers of pieces, then the chosen ones. More than a thousand distinct labels are not languages; that
    is an error.
    """
    rows = df.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"), held_out(id_col).alias("apart"))
    learn = rows.where("l IS NOT NULL AND t IS NOT NULL AND NOT apart").withColumn("n", F.greatest(F.lit(1), F.ceil(F.length("t") / longest)).cast("int"))
    counts = learn.groupBy("l").agg(F.sum("n").alias("n")).limit(1001).collect()
    if len(counts) > 1000:
        raise ValueError("more than 1000 labels")
    if not counts:
        return train([], [])
    each = min(per_language, in_all // len(counts))
    shares = F.create_map(*(x for r in counts for x in (F.lit(r[0]), F.lit(min(1.0, each / r[1])))))
    unit = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "i", k)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    picked = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda k: unit(k) < F.try_element_at(shares, F.col("l")))
    chosen = learn.select("i", "t", "l", F.explode(picked).alias("k")).select("i", "k", F.substring("t", F.col("k") * longest + 1, F.lit(longest)).alias("t"), "l")
    found = chosen.orderBy(F.md5(F.concat_ws("|", "i", "k", F.lit(seed))), "i", "k", "t", "l").limit(2 * in_all).collect()
    sample = sorted((r.i or "", r.t, r.l) for r in found)
    return train([t for _, t, _ in sample], [y for _, _, y in sample], seed=seed)


_PREDICTORS: dict[int, Predictor] = {}


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ``lang_pred``, ``score``, ``accepted``) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    name = id(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _PREDICTORS or _PREDICTORS[name].model is not shared.value:
            _PREDICTORS.clear()
            _PREDICTORS[name] = Predictor(shared.value)
        known = _PREDICTORS[name]
        for batch in batches:
            found = [known.predict(t.as_py()) for t in batch.column(1)]
            lang, score, accepted = (list(x) for x in zip(*found)) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                names=[id_col, "lang_pred", "score", "accepted"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, accepted boolean")
