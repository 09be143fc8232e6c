"""Text scores: BLEU, ROUGE-L, CIDEr and exact match.

Inputs have (id, hyp string, refs array<string>); every id once. Texts are dealt by id once, and what is
counted per id stays where it is; sums over ids are plain aggregates, so partial results merge on the map side.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailweave.functions.arrays import lcs_lengths, ngrams, spaced, words
from trailweave.sources.durable import durable
from trailweave.sources.spread import spread

# Fixed values of the scores' definitions.
ORDERS = (1, 2, 3, 4)
SMALL, TINY = 1e-9, 1e-15
BETA = 1.2
SIGMA = 6.0


def paired(hyps: DataFrame, refs: DataFrame) -> DataFrame:
    """(id, hyp, refs) from (id, hyp) and (id, refs); an id that only one side has raises."""
    joined = hyps.withColumn("_h", F.lit(True)).join(refs.withColumn("_r", F.lit(True)), "id", "full")
    ok = F.col("_h").isNotNull() & F.col("_r").isNotNull()
    return joined.select("id", F.when(ok, F.col("hyp")).otherwise(F.raise_error(F.lit("hypotheses and references differ in ids"))).alias("hyp"), "refs")


# ---- BLEU ----------------------------------------------------------------------------------------


def _hashes(tokens: Column) -> tuple[Column, Column]:
    """Two independent hashes of every token."""
    return F.transform(tokens, lambda w: F.xxhash64(w)), F.transform(tokens, lambda w: F.xxhash64(F.lit(1), w))


def _few_refs(most: int | None) -> Column:
    """The references; of an id that has more than ``most`` they raise."""
    if most is None:
        return F.col("refs")
    return F.when(F.size("refs") <= most, F.col("refs")).otherwise(F.raise_error(F.lit(f"an id has more than {most} references")))


def _windows(tokens: Sequence[str], n: int) -> Counter:
    """How often each n-gram occurs."""
    return Counter(zip(*(tokens[k:] for k in range(n))))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _clipped(hyp: pd.Series, refs: pd.Series) -> pd.Series:
    """Per order: the n-grams of an array of tokens, each counted up to its greatest count in one of some arrays."""

    def of(h: Sequence[str] | None, rs: Sequence[Sequence[str]] | None) -> list[int]:
        rs = [] if rs is None else [list(r) for r in rs if r is not None]
        h, out = [] if h is None else list(h), []
        for n in ORDERS:
            own, greatest = _windows(h, n), {}
            for r in rs:
                for g, c in _windows(r, n).items():
                    if g in own and c > greatest.get(g, 0):
                        greatest[g] = c
            out.append(sum(min(own[g], c) for g, c in greatest.items()))
        return out

    return pd.Series([of(h, rs) for h, rs in zip(hyp, refs)], dtype=object)


#: Odd multipliers that make one key of the hashes of an n-gram's tokens.
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _keys(one: np.ndarray, two: np.ndarray, n: int) -> list[np.ndarray]:
    """Every n-gram of a text as 128 bits of its tokens' hashes: no text to carry."""
    made = []
    for hashes, by in zip((one, two), _MIX):
        h, size = hashes.astype(np.int64).view(np.uint64), max(0, len(hashes) - n + 1)
        key = np.full(size, n, np.uint64)
        for k in range(n):
            key = key * by + h[k : k + size]
            key = key ^ key >> np.uint64(29)
        made.append(key.view(np.int64))
    return made


def reference_length(length: Column, lengths: Column, option: str) -> Column:
    """The length a hypothesis is held against: the closest (of two the shorter), the shortest or the mean."""
    if option == "shortest":
        return F.array_min(lengths).cast("double")
    if option == "average":
        return F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x) / F.size(lengths)
    return F.array_min(F.transform(lengths, lambda x: F.struct(F.abs(x - length).alias("off"), x.alias("n"))))["n"].cast("double")


def bleu_counts(rows: DataFrame, option: str = "closest", most_refs: int | None = None) -> DataFrame:
    """Per id: testlen, reflen, guess1..4 and correct1..4 (clipped by the greatest count in one reference).

    Nothing but the texts is dealt: an id is counted where its texts are. More references than ``most_refs``, if it is given, raise.
    """
    r = spread(rows.select("id", "hyp", "refs"), "id").select("id", words("hyp").alias("_hyp"), F.transform(_few_refs(most_refs), lambda t: words(t)).alias("_refs"))
    sizes = F.transform("_refs", lambda t: F.size(t))
    r = r.withColumn("_hits", _clipped("_hyp", "_refs"))
    return r.select(
        "id", F.size("_hyp").cast("long").alias("testlen"), reference_length(F.size("_hyp"), sizes, option).alias("reflen"),
        *(F.greatest(F.lit(0), F.size("_hyp") - (n - 1)).cast("long").alias(f"guess{n}") for n in ORDERS), *(F.col("_hits")[n - 1].alias(f"correct{n}") for n in ORDERS),
    )


def _bleu(orders: int) -> list[Column]:
    """bleu1.. from the counts' columns."""
    ratio = (F.col("testlen") + TINY) / (F.col("reflen") + SMALL)
    brevity = F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(1.0)
    parts = [(F.col(f"correct{n}") + TINY) / (F.col(f"guess{n}") + SMALL) for n in ORDERS[:orders]]
    return [(F.pow(reduce(lambda a, b: a * b, parts[:n]), F.lit(1.0 / n)) * brevity).alias(f"bleu{n}") for n in range(1, orders + 1)]


def bleu_corpus(counts: DataFrame) -> DataFrame:
    """One row: bleu1..4 of the summed counts. Counts of several sets are merged by a union before."""
    names = [f"{k}{n}" for k in ("guess", "correct") for n in ORDERS]
    total = counts.agg(F.sum("testlen").alias("testlen"), F.sum("reflen").alias("reflen"), *(F.sum(c).alias(c) for c in names))
    return total.select(*_bleu(4), "testlen", "reflen")


def lengths(counts: DataFrame) -> DataFrame:
    """One row: ``testlen``, ``reflen`` and their ``ratio``, as BLEU takes it."""
    total = counts.agg(F.sum("testlen").alias("testlen"), F.sum("reflen").alias("reflen"))
    return total.withColumn("ratio", (F.col("testlen") + TINY) / (F.col("reflen") + SMALL))


def caption_bundle(rows: DataFrame, most_refs: int | None = None) -> DataFrame:
    """(metric, value): BLEU-1..4 alone, as they are."""
    b = bleu_corpus(bleu_counts(rows, most_refs=most_refs))
    return b.select(F.explode(F.array(*(F.struct(F.lit(f"bleu{n}").alias("metric"), F.col(f"bleu{n}").alias("value")) for n in ORDERS))).alias("m")).select("m.*")


def bleu_sentences(counts: DataFrame) -> DataFrame:
    """bleu1..4 of every id."""
    return counts.select("id", *_bleu(4))


# ---- ROUGE-L -------------------------------------------------------------------------------------


def rouge_l(rows: DataFrame) -> DataFrame:
    """(id, rouge_l): best precision and best recall over the references, each for itself; 0 if either is 0."""
    sizes = F.transform("refs", lambda r: F.size(spaced(r)))
    each = F.zip_with(lcs_lengths("refs", "hyp"), sizes, lambda lcs, n: F.struct(lcs.alias("lcs"), n.alias("n")))
    r = rows.select("id", F.size(spaced("hyp")).alias("_n"), each.alias("_e"))
    best = lambda f: F.array_max(F.transform("_e", f))
    p, q = best(lambda e: e["lcs"] / F.col("_n")), best(lambda e: e["lcs"] / e["n"])
    score = F.when((p > 0) & (q > 0), (1 + BETA**2) * p * q / (q + BETA**2 * p)).otherwise(0.0)
    return r.select("id", score.alias("rouge_l"))


# ---- CIDEr ---------------------------------------------------------------------------------------


def document_frequency(rows: DataFrame) -> DataFrame:
    """(order, gram, df): in how many ids' references an n-gram occurs."""
    texts = rows.select("id", F.transform("refs", lambda t: words(t)).alias("texts"))
    per_id = F.explode(F.array(*(F.struct(F.lit(n).alias("order"), F.array_distinct(F.flatten(F.transform("texts", lambda t: ngrams(t, n)))).alias("grams")) for n in ORDERS)))
    grams = texts.select(per_id.alias("g")).select("g.order", F.explode("g.grams").alias("gram"))
    return grams.groupBy("order", "gram").agg(F.count(F.lit(1)).alias("df"))


#: Ids whose texts are counted together.
IDS_OF_A_BUCKET = 1000


def _keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(h1, h2, df) of rows (one, two, df): hashes of an n-gram's tokens become its key."""
    for f in frames:
        keys = [[k[0] for k in _keys(np.asarray(a), np.asarray(b), len(a))] for a, b in zip(f["one"], f["two"])]
        yield pd.DataFrame({"h1": [k[0] for k in keys], "h2": [k[1] for k in keys], "df": f["df"]})


def _numbered_keys(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each key is first met, in the order of keys; the number of each place's key)."""
    order = np.lexsort((h2, h1))
    new = np.r_[True, (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)][: len(order)]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


class _Counted:
    """The n-grams of some ids' texts: distinct keys in their order, and how often each text has each.

    Texts are numbered through; an id's hypothesis comes before its references.
    """

    def __init__(self, f: pd.DataFrame):
        f = f[f["one"].notna()]  # an id without an array of references has no texts
        self.ids = f["id"]
        texts = [(r, a, b) for r, (one, two) in enumerate(zip(f["one"], f["two"])) for a, b in zip(one, two)]
        self.row = np.array([r for r, *_ in texts], np.int64)
        sizes = np.array([len(a) for _, a, _ in texts], np.int64)
        one, two = (np.concatenate([np.zeros(0, np.int64), *(t[k] for t in texts)]) for k in (1, 2))
        text = np.repeat(np.arange(len(texts)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(one))  # tokens of the text from here on
        found = []
        for n in ORDERS:
            own = np.flatnonzero(left >= n)
            found.append((*(k[own] for k in _keys(one, two, n)), text[own], np.full(len(own), n - 1)))
        h1, h2, text, order = (np.concatenate(x) for x in zip(*found))
        first, key = _numbered_keys(h1, h2)
        self.h1, self.h2, self.order = h1[first], h2[first], order[first]
        self.place, self.n = np.unique(key * max(1, len(texts)) + text, return_counts=True)
        self.key, self.text = np.divmod(self.place, max(1, len(texts)))
        self.hyp = np.searchsorted(self.row, self.row)  # the hypothesis of each text's id

    def in_references(self) -> np.ndarray:
        """Of how many ids the references have each key."""
        ref = self.hyp[self.text] != self.text
        met = np.unique(self.key[ref] * max(1, len(self.ids)) + self.row[self.text[ref]])
        return np.bincount(met // max(1, len(self.ids)), minlength=len(self.h1))

    def cosines(self, weight: np.ndarray) -> pd.DataFrame:
        """(id, sums): of each reference the clipped cosines of all orders together; ``weight`` is that of each key."""
        w, size = self.n * weight[self.key], len(self.row) * len(ORDERS)
        at = self.text * len(ORDERS) + self.order[self.key]
        norm = np.sqrt(np.bincount(at, w * w, size)).reshape(-1, len(ORDERS))
        own = self.key * max(1, len(self.row)) + self.hyp[self.text]  # the same key in the id's hypothesis
        where = np.minimum(np.searchsorted(self.place, own), max(0, len(self.place) - 1))
        both = self.place[where] == own
        dot = np.bincount(at, np.where(both, np.minimum(w[where], w) * w, 0.0), size).reshape(-1, len(ORDERS))
        of = norm * norm[self.hyp]
        sums = np.divide(dot, of, out=dot.copy(), where=of != 0).sum(axis=1)
        ends = np.searchsorted(self.row, np.arange(len(self.ids) + 1))
        return pd.DataFrame({"id": self.ids.to_numpy(), "sums": [sums[a + 1 : b] for a, b in zip(ends[:-1], ends[1:])]})


def cider(rows: DataFrame, frequency: DataFrame | None = None, documents: float | None = None, most_refs: int | None = None) -> DataFrame:
    """(id, cider). ``frequency`` (as ``document_frequency`` makes it) and ``documents`` may come from another corpus.

    Ids are dealt to buckets by hash. A bucket sends each of its distinct n-grams once, as a key of 128 bits with the
    number of its ids whose references have it, to where the key's rows meet. Back come frequencies above one (none
    and one weigh the same), by the key's place in the bucket's order, which is made again from the same texts.
    """
    rows = durable(rows.select("id", "hyp", _few_refs(most_refs).alias("refs")))  # read four times
    count = rows.count()
    of = float(count if documents is None else documents)
    texts = F.transform(F.concat(F.array("hyp"), "refs"), lambda t: F.coalesce(words(t), F.array().cast("array<string>")))
    dealt = spread(rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-count // IDS_OF_A_BUCKET))))), "bucket")
    hashed = dealt.select("bucket", "id", F.transform(texts, lambda t: _hashes(t)[0]).alias("one"), F.transform(texts, lambda t: _hashes(t)[1]).alias("two"))

    def sent(f: pd.DataFrame) -> pd.DataFrame:
        c = _Counted(f)
        return pd.DataFrame({"bucket": f["bucket"].iloc[0], "place": np.arange(len(c.h1)), "h1": c.h1, "h2": c.h2, "n": c.in_references()})

    def scored(f: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        c = _Counted(f)
        df = np.ones(len(c.h1))
        df[back["place"].to_numpy(np.int64)] = back["df"]
        return c.cosines(np.log(max(of, 1.0)) - np.log(df))

    found = hashed.groupBy("bucket").applyInPandas(sent, "bucket long, place long, h1 long, h2 long, n long")
    if frequency is None:
        met = spread(found, "h1", "h2").withColumn("df", F.sum("n").over(Window.partitionBy("h1", "h2")))
    else:
        one, two = _hashes(F.split("gram", " ", -1))
        known = frequency.select(one.alias("one"), two.alias("two"), "df").mapInPandas(_keyed, "h1 long, h2 long, df long")
        met = found.join(known, ["h1", "h2"])
    back = spread(met.where("df > 1").select("bucket", "place", "df"), "bucket")
    sums = hashed.groupBy("bucket").cogroup(back.groupBy("bucket")).applyInPandas(scored, f"id {rows.schema['id'].dataType.simpleString()}, sums array<double>")
    bigrams = lambda n: F.greatest(F.lit(0), n - 1)
    off = lambda t: bigrams(F.size(words("hyp"))) - bigrams(F.size(words(t)))
    lengths = rows.select("id", F.transform("refs", lambda t: F.exp(-(off(t) * off(t)) / (2 * SIGMA**2))).alias("penalties"))
    total = F.aggregate(F.zip_with("sums", "penalties", lambda s, p: F.coalesce(s * p, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return lengths.join(sums, "id", "left").select("id", (total / len(ORDERS) / F.size("penalties") * 10.0).alias("cider"))


# ---- exact match and bundles ---------------------------------------------------------------------


def exact_match(rows: DataFrame) -> DataFrame:
    """(id, em): whether the hypothesis is one of the references."""
    return rows.select("id", F.array_contains("refs", F.col("hyp")).cast("double").alias("em"))


def bundle(rows: DataFrame) -> DataFrame:
    """(metric, value) of all scores, times 100."""
    rows = durable(spread(rows.select("id", "hyp", "refs"), "id"))  # read once for each score
    b = caption_bundle(rows)
    one = lambda df, c: df.agg(F.avg(c).alias("value")).select(F.lit(c).alias("metric"), "value")
    all_ = reduce(DataFrame.unionByName, [b, one(rouge_l(rows), "rouge_l"), one(cider(rows), "cider"), one(exact_match(rows), "em")])
    return all_.select("metric", (F.col("value") * 100).alias("value"))


def masked_labels(ids: str, segments: str, ignored: int = -100) -> Column:
    """Labels that ignore the prompt: ids where the segment is not 0."""
    return F.zip_with(ids, segments, lambda i, s: F.when(s == 0, F.lit(ignored).cast("long")).otherwise(i.cast("long")))


def cross_entropy(rows: DataFrame, label: str, log_p: str, ignored: int = -100) -> DataFrame:
    """Summed negative log-probabilities of labels that count."""
    return rows.agg(F.sum(F.when(F.col(label) != ignored, -F.col(log_p)).otherwise(0.0)).alias("loss"))
