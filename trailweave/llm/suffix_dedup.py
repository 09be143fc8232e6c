"""Suffix-array dedup: remove every byte that a repeated 200-byte string covers.

1. Anchors. Of each 200-byte window the 32-byte gram with the least hash is its anchor, so equal
   windows have anchors with equal grams. Runs of windows share an anchor (one per about 85 bytes);
   every window belongs to just one occurrence of one gram.
2. Grams that occur once in all documents are done with: their windows occur once. The documents that
   have others are read again, and give each such anchor's context: the bytes its windows cover.
3. Contexts meet by gram. A task folds identical contexts into one with a count and cuts the others into
   words, which end after a certain byte. It sorts the suffixes that begin at words (``suffix_array``)
   and compares neighbours. A window that begins x bytes before a word is repeated if a suffix beside it
   shares 200 - x bytes and the x bytes before it are the same. Where a word would be as long as a
   window, more bytes end words, at last all.
4. A gram with over ``HOT`` occurrences does not bring them all to one task. Its identical contexts are
   folded by an aggregation with map-side counts first; those that occur twice are repeated as a whole.
   The distinct ones are cut again by a second anchor of each window, chosen by another hash, so that equal
   windows still meet, now by both grams; these parts are folded and sorted in the same way. Where even two
   grams share over ``MOST_CONTEXTS`` distinct parts, the windows themselves are grouped, byte by byte.
5. Spans of repeated windows return to their documents, which lose them.

Shuffled are grams (twice), texts (once: both joins use the same exchange) and contexts. No group of
unbounded size meets in a task.

Defined cases: a null text is empty and texts under 200 bytes keep all; rows that repeat an id and
text are documents of their own, so they remove each other wherever they are long enough; null ids are
ids; an empty table gives an empty result; other columns stay out (``deduplicated`` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import whole_text
from trailweave.llm.suffix_array import suffix_array

LENGTH = 200
GRAM = 32
SPAN = LENGTH - GRAM + 1  # grams of a window
#: Occurrences of a gram beyond which identical contexts are folded before they meet in a task.
HOT = 256
#: Distinct parts of contexts, of two grams, that meet in a task.
MOST_CONTEXTS = 1000
#: By so many numbers a context's occurrences are dealt when they learn of its spans.
SALTS = 8
#: Windows worked on at a time, and bytes sorted at a time.
BLOCK = 1 << 17
SORT_BYTES = 1 << 18
#: The mean length of a word that is aimed at, in bytes.
WORD = 16
#: Bytes that end a word where one byte alone leaves too long ones: white space, some punctuation and digits.
WORD_ENDS = b" \t\n\v\f\r.,;:!?()[]{}<>|/\\'\"#*$%&=+-_0123456789"

_U = np.uint64
_TABLE = np.random.default_rng(200).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_POSITION = _U((1 << 20) - 1)


def _gram_hashes(data: bytes) -> np.ndarray:
    """A polynomial hash of every 32-byte gram, by doubling."""
    h, base, width = _TABLE[np.frombuffer(data, np.uint8)], _BASE, 1
    while width < GRAM:
        h = h[:-width] * _U(base) + h[width:]
        base, width = base * base & (1 << 64) - 1, 2 * width
    return h


def anchors(data: bytes, turn: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, first, last, tied): the windows beginning at first..last have this gram as their anchor.

    ``tied``: the text is periodic there, so that windows of one anchor may equal each other. Another
    ``turn`` takes other anchors.
    """
    windows = len(data) - LENGTH + 1
    parts = [_anchors(data[a : min(a + BLOCK, windows) + LENGTH - 1], a, turn) for a in range(0, windows, BLOCK)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    gram, first, last, tied = (np.concatenate(x) for x in zip(*parts))
    return gram.view(np.int64), first, last, tied


def _anchors(data: bytes, base: int, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = _gram_hashes(data)
    mixed = (h ^ (h >> _U(29 + turn))) * _U(0xBF58476D1CE4E5B9 + 2 * turn)
    if turn:
        mixed = (mixed ^ (mixed >> _U(32))) * _U(0x94D049BB133111EB)
    least = (mixed & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < SPAN:
        least = np.minimum(least[: len(least) - (SPAN - width)], least[SPAN - width :])
    where = (least & _POSITION).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(where) - 1]])
    at = where[first]
    grams = h[at]
    tied = np.zeros(len(first), bool)
    if (grams[1:] == grams[:-1]).any():
        first, last, at, tied = _thinned(first, last, at, grams)
    return h[at], first + base, last + base, tied


def _thinned(first: np.ndarray, last: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of equal grams in a row (periodic text) only as many as are needed: any of them serves as key."""
    out: list[tuple[int, int, int, int]] = []
    k = 0
    while k < len(first):
        e = k
        while e + 1 < len(first) and value[e + 1] == value[k]:
            e += 1
        s = int(first[k])
        if e == k:
            out.append((s, int(last[k]), int(at[k]), 0))
        else:
            ties, stop = at[k : e + 1], int(last[e])
            while s <= stop:
                q = int(ties[np.searchsorted(ties, s + SPAN - 1, side="right") - 1])
                out.append((s, min(q, stop), q, 1))
                s = q + 1
        k = e + 1
    made = np.array(out, dtype=np.int64)
    return made[:, 0], made[:, 1], made[:, 2], made[:, 3] > 0


# ---- repeated windows of contexts that met -------------------------------------------------------


def word_end(contexts: list[bytes]) -> bytes:
    """The byte that ends a word: the one whose share of the contexts is nearest to 1 / WORD."""
    share = np.bincount(np.frombuffer(b"".join(contexts), np.uint8), minlength=256)
    return bytes([int(np.abs(share - share.sum() / WORD).argmin())])


def _long_word(ends: bytes) -> re.Pattern[bytes]:
    """A stretch that may hold a whole window without a word's end before its last byte."""
    return re.compile(b"[^" + re.escape(ends) + b"]{%d}" % (LENGTH - 1), re.DOTALL)


def repeated_windows(contexts: list[bytes], ends: bytes | None = None) -> list[np.ndarray]:
    """For each of some distinct contexts, whether the window at each start occurs elsewhere among them.

    ``ends``: the bytes that end a word; the contexts have no long word for them. None: every byte does.
    """
    text = b"".join(contexts)
    begins = np.cumsum([0] + [len(c) for c in contexts])
    of = np.repeat(np.arange(len(contexts)), np.diff(begins))
    codes = np.frombuffer(text, np.uint8)
    closes = np.isin(codes, np.frombuffer(ends, np.uint8)) if ends else np.ones(len(codes), bool)
    at = np.union1d(np.flatnonzero(closes[:-1]) + 1, begins[:-1])  # where words begin
    cuts = at.tolist() + [len(text)]
    words = [text[x:y] for x, y in zip(cuts, cuts[1:])]
    rank = {w: k for k, w in enumerate(sorted(set(words)), 1)}
    symbols_at = np.arange(len(words)) + of[at]
    symbols = np.zeros(len(words) + len(contexts), np.int64)  # 0 ends a context
    symbols[symbols_at] = [rank[w] for w in words]
    word_of = np.full(len(symbols), -1, np.int64)
    word_of[symbols_at] = np.arange(len(words))
    order = word_of[suffix_array(symbols.tolist())]
    order = order[order >= 0]  # words in the order of their suffixes
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    shared = _shared_bytes(text, at[order[:-1]], at[order[1:]])

    starts = np.flatnonzero(np.arange(len(text)) + LENGTH <= begins[1:][of])
    word = np.searchsorted(at, starts, side="right")  # the first word that begins inside a window: its own bytes tell
    ahead = at[word] - starts
    family = np.zeros(len(starts), np.int64)  # of windows that share what follows
    for x in np.unique(ahead).tolist():
        now = np.flatnonzero(ahead == x)
        family[now] = np.concatenate([[0], np.cumsum(shared < LENGTH - x)])[place[word[now]]]
    named, rest = _before(text, at, word, ahead)
    keys = (rest, named, family, ahead)
    by = np.lexsort(keys)
    same = np.ones(max(0, len(by) - 1), bool)
    for key in keys:
        same &= key[by[1:]] == key[by[:-1]]
    again = np.zeros(len(text), bool)
    again[starts[by[1:][same]]] = True
    again[starts[by[:-1][same]]] = True
    return [again[b : max(b, e - LENGTH + 1)] for b, e in zip(begins[:-1], begins[1:])]


def _before(text: bytes, at: np.ndarray, word: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``ahead`` bytes before each window's word, as a name for whole blocks of eight and the bytes left over."""
    padded = bytes(LENGTH + 8) + text
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    end = at + LENGTH + 8
    named = np.zeros(len(at), np.int64)
    most = np.zeros(len(at), np.int64)
    np.maximum.at(most, word, ahead)
    out = np.zeros(len(ahead), np.int64)
    for block in range(1, int(ahead.max(initial=0)) // 8 + 1):
        live = np.flatnonzero(most >= 8 * block)
        bytes_ = np.unique(eight[end[live] - 8 * block], return_inverse=True)[1]
        named[live] = np.unique(named[live] * len(live) + bytes_, return_inverse=True)[1]
        now = np.flatnonzero(ahead // 8 == block)
        out[now] = named[word[now]]
    left = ahead % 8
    tail = eight[end[word] - 8 * (ahead // 8) - 8] >> (_U(64) - _U(8) * np.maximum(left, 1).astype(np.uint64))
    return out, np.where(left > 0, tail, _U(0))


def _shared_bytes(text: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The common prefix of the texts from a and from b, up to LENGTH bytes."""
    padded = text + bytes(2 * LENGTH)
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out = np.full(len(a), LENGTH, np.int64)
    live = np.arange(len(a))
    for k in range(0, LENGTH, 8):
        differ = eight[a[live] + k] ^ eight[b[live] + k]
        found = np.flatnonzero(differ)
        if len(found):
            d = differ[found]
            low = d & (~d + _U(1))
            out[live[found]] = k + ((np.frexp(low.astype(np.float64))[1] - 1) >> 3)
            live = live[differ == 0]
        if not len(live):
            break
    return np.minimum(out, LENGTH)


def covered(again: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the marked windows cover."""
    starts = np.flatnonzero(again)
    return merged(zip(starts.tolist(), (starts + LENGTH).tolist()))


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def judged(groups: list[dict[bytes, int]]) -> list[dict[bytes, list[tuple[int, int]]]]:
    """For each of some complete groups of contexts with counts, the spans of what is repeated in each context."""
    able = [list(g) for g in groups if len(g) > 1 or any(n == 1 for n in g.values())]  # a lone one is periodic
    ends = [word_end([c for g in able for c in g]), WORD_ENDS] if able else []
    sorted_ones: dict[bytes | None, list[bytes]] = {e: [] for e in [*ends, None]}
    for contexts in able:
        fit = next((e for e in ends if not any(_long_word(e).search(c) for c in contexts)), None)
        sorted_ones[fit] += contexts
    again: dict[bytes, np.ndarray] = {}
    for fit, contexts in sorted_ones.items():
        if contexts:
            again.update(zip(contexts, repeated_windows(contexts, fit)))
    return [{c: [(0, len(c))] if n > 1 else covered(again[c]) for c, n in g.items()} for g in groups]


# ---- frames --------------------------------------------------------------------------------------


def _as_bytes(cell: pa.Scalar) -> bytes:
    return (cell.as_py() or "").encode("utf-8", "surrogatepass")


def _grams(rows: DataFrame) -> DataFrame:
    """(_row, gram, n): the grams of each row with how often each is an anchor in it; twice if periodic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, gram, n = [], [], []
            for r, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams, _, _, tied = anchors(_as_bytes(cell))
                distinct, count = np.unique(np.concatenate([grams, grams[tied]]), return_counts=True)
                row.append(np.full(len(distinct), r, np.int64))
                gram.append(distinct)
                n.append(count)
            if row:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (row, gram, n)], names=["_row", "gram", "n"])

    return rows.select("_row", "text").mapInArrow(run, "_row long, gram long, n long")


def _contexts(rows: DataFrame, grams_col: str, id_type: str) -> DataFrame:
    """(gram, context, _row, id, first) of the anchors whose gram is among the row's ``grams_col``.

    Takes ``rest`` along unused: the texts' exchange then has the same columns in every join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, context, row, first, source = [], [], [], [], []
            for k, (r, cell, wanted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3))):
                data = _as_bytes(cell)
                g, s, e, _ = anchors(data)
                for m in np.flatnonzero(np.isin(g, wanted.values.to_numpy())).tolist():
                    gram.append(g[m])
                    context.append(data[s[m] : e[m] + LENGTH])
                    row.append(r)
                    first.append(s[m])
                    source.append(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram, pa.int64()), pa.array(context, pa.binary()), pa.array(row, pa.int64()), batch.column(1).take(pa.array(source, pa.int64())), pa.array(first, pa.int64())],
                names=["gram", "context", "_row", "id", "first"],
            )

    return rows.select("_row", "id", "text", grams_col, "rest").mapInArrow(run, f"gram long, context binary, _row long, id {id_type}, first long")


def _by_gram(rows: Iterator[tuple], most: int) -> Iterator[list[dict[bytes, list[tuple]]]]:
    """Groups of complete grams: of each its contexts with what goes with them; cut where over ``most`` bytes are held."""
    groups: list[dict[bytes, list[tuple]]] = []
    held, last = 0, None
    for gram, context, *rest in rows:
        if gram != last:
            if held >= most:
                yield groups
                groups, held = [], 0
            groups.append({})
            last = gram
        at = groups[-1].setdefault(context, [])
        if not at:
            held += len(context)
        at.append(tuple(rest))
    if groups:
        yield groups


def _cold_spans(contexts: DataFrame, id_type: str) -> DataFrame:
    """(_row, id, start, end) of repeats among contexts; a gram's contexts meet in one task, at most HOT of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def rows() -> Iterator[tuple]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(3).type
                yield from zip(*(c.to_pylist() for c in batch.columns))

        for groups in _by_gram(rows(), SORT_BYTES):
            spans = judged([{c: len(at) for c, at in g.items()} for g in groups])
            found = [(row, id_, first + a, first + b) for g, s in zip(groups, spans) for c, at in g.items() for a, b in s[c] for row, id_, first in at]
            columns = list(zip(*found)) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                names=["_row", "id", "start", "end"],
            )

    met = contexts.repartition("gram").sortWithinPartitions("gram")
    return met.mapInArrow(run, f"_row long, id {id_type}, start long, end long")


_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _sorted_spans(distinct: DataFrame) -> DataFrame:
    """(key, spans) of distinct contexts (key, gram, context, n), at most MOST_CONTEXTS of a gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        for groups in _by_gram(rows, SORT_BYTES):
            spans = judged([{c: at[0][1] for c, at in g.items()} for g in groups])
            found = [(at[0][0], [{"a": a, "b": b} for a, b in s[c]]) for g, s in zip(groups, spans) for c, at in g.items() if s[c]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([x for _, x in found], _SPANS)], names=["key", "spans"])

    met = distinct.select("gram", "context", "key", "n").repartition("gram").sortWithinPartitions("gram")
    return met.mapInArrow(run, "key binary, spans array<struct<a:long,b:long>>")


def _folded(contexts: DataFrame) -> DataFrame:
    """(key, gram, context, n): distinct contexts, named by 128 bits."""
    one = contexts.groupBy("key", "gram").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("context"), F.max("context").alias("other"))
    same = F.when(F.col("context") == F.col("other"), F.col("context")).otherwise(F.raise_error(F.lit("two contexts share a 128-bit hash")).cast("binary"))
    return one.select("key", "gram", same.alias("context"), "n")


def _keyed(contexts: DataFrame) -> DataFrame:
    return contexts.withColumn("key", F.unhex(F.md5("context")))


def _narrowed(distinct: DataFrame) -> DataFrame:
    """(gram, context, owner, first): the parts of contexts whose windows share a second anchor; gram names both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, gram, context in zip(*(c.to_pylist() for c in batch.columns)):
                second, first, last, _ = anchors(context, 1)
                both = (second.view(np.uint64) * _U(_BASE) + np.array([gram], np.int64).view(np.uint64)).view(np.int64)
                out += [(g, context[a : b + LENGTH], key, a) for g, a, b in zip(both.tolist(), first.tolist(), last.tolist())]
            columns = list(zip(*out)) if out else [[], [], [], []]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["gram", "context", "owner", "first"])

    return distinct.select("key", "gram", "context").mapInArrow(run, "gram long, context binary, owner binary, first long")


def _windows(distinct: DataFrame) -> DataFrame:
    """(key, n, at, window): every window of a context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, context, count in zip(*(c.to_pylist() for c in batch.columns)):
                starts = range(len(context) - LENGTH + 1)
                columns = [
                    pa.array([one] * len(starts), pa.binary()), pa.array([count] * len(starts), pa.int64()),
                    pa.array(starts, pa.int64()), pa.array([context[k : k + LENGTH] for k in starts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "at", "window"])

    return distinct.select("key", "context", "n").mapInArrow(run, "key binary, n long, at long, window binary")


def _counted_spans(distinct: DataFrame) -> DataFrame:
    """(key, spans) of distinct contexts (key, context, n) by grouping their windows, any number of them."""
    windows = _windows(distinct)
    often = windows.groupBy("window").agg(F.sum("n").alias("all")).where("all > 1").select(F.col("window").alias("w"))
    met = windows.select("key", "at", "window").join(often, F.col("window") == F.col("w"))
    starts = met.groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("starts"))
    # maximal runs: a start more than LENGTH behind the one before opens a new one
    opens = F.filter("starts", lambda s, k: F.coalesce(s > F.get("starts", k - 1) + LENGTH, F.lit(True)))
    closes = F.filter("starts", lambda s, k: F.coalesce(F.get("starts", k + 1) > s + LENGTH, F.lit(True)))
    runs = F.zip_with(opens, closes, lambda a, b: F.struct(a.alias("a"), (b + LENGTH).alias("b")))
    return starts.select("key", runs.alias("spans"))


def _told(occurrences: DataFrame, spans: DataFrame, owner: list[str]) -> DataFrame:
    """(owner.., a, b): the spans of the contexts of occurrences (key, owner.., first), salted."""
    dealt = spans.select(F.col("key").alias("k"), "spans", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("t"))
    salted = occurrences.select("key", *owner, "first", F.pmod(F.xxhash64(*owner, "first"), F.lit(SALTS)).cast("int").alias("s"))
    met = salted.join(dealt, (F.col("key") == F.col("k")) & (F.col("s") == F.col("t")))
    return met.select(*owner, "first", F.explode("spans").alias("x")).select(*owner, (F.col("first") + F.col("x.a")).alias("a"), (F.col("first") + F.col("x.b")).alias("b"))


def _hot_spans(contexts: DataFrame, most: int) -> DataFrame:
    """(_row, id, start, end) for grams with any number of occurrences."""
    keyed = _keyed(contexts)
    distinct = _folded(keyed)
    parts = _keyed(_narrowed(distinct))
    folded = _folded(parts)
    sizes = folded.groupBy(F.col("gram").alias("g")).agg(F.count(F.lit(1)).alias("contexts"))
    sized = folded.join(sizes, F.col("gram") == F.col("g"))
    of_parts = _sorted_spans(sized.where(F.col("contexts") <= most)).unionByName(_counted_spans(sized.where(F.col("contexts") > most)))
    cut = _told(parts, of_parts, ["owner"]).groupBy(F.col("owner").alias("key")).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.length("context").cast("long").alias("b")))
    spans = distinct.where("n > 1").select("key", whole.alias("spans")).unionByName(cut)
    return _told(keyed, spans, ["_row", "id"]).select("_row", "id", F.col("a").alias("start"), F.col("b").alias("end"))


def _texts(df: DataFrame, id_col: str, text_col: str, rest: list[str]) -> DataFrame:
    """(_row, id, text, rest): _row is a hash of id and text, by which a row's parts find each other again."""
    others = F.struct(*(F.col(c) for c in rest)) if rest else F.lit(0)
    rows = df.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"), others.alias("rest"))
    return rows.select(F.xxhash64("id", "text").alias("_row"), "id", "text", "rest")


def repeated_spans(rows: DataFrame, hot: int = HOT, most: int = MOST_CONTEXTS) -> DataFrame:
    """(_row, id, start, end) of repeats in rows (_row, id, text); spans may overlap."""
    id_type = rows.schema["id"].dataType.simpleString()
    grams = _grams(rows)
    counts = grams.groupBy("gram").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select(F.col("gram").alias("g"), (F.col("all") > hot).alias("hot"))
    wanted = grams.select("_row", "gram").join(counts, grams["gram"] == counts["g"])

    def side(is_hot: bool) -> Column:
        return F.collect_set(F.when(F.col("hot") == is_hot, F.col("gram")))

    lists = wanted.groupBy("_row").agg(side(False).alias("cold_grams"), side(True).alias("hot_grams")).withColumnRenamed("_row", "r")
    met: Callable[[DataFrame], DataFrame] = lambda these: rows.join(these, rows["_row"] == these["r"])
    cold = _contexts(met(lists.where(F.size("cold_grams") > 0)), "cold_grams", id_type)
    hot_ones = _contexts(met(lists.where(F.size("hot_grams") > 0)), "hot_grams", id_type)
    return _cold_spans(cold, id_type).unionByName(_hot_spans(hot_ones, most))


def _with_spans(df: DataFrame, id_col: str, text_col: str, hot: int, most: int, rest: list[str]) -> DataFrame:
    """(id, text, rest, spans) of every row; spans as collected, to be merged."""
    rows = _texts(df, id_col, text_col, rest)
    spans = repeated_spans(rows, hot, most).groupBy("_row", "id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = spans.select(F.col("_row").alias("r"), F.col("id").alias("i"), "spans")
    # not written as an equality of ids, which would become a second key: the texts' exchange serves both joins
    same_id = F.coalesce((rows["id"] <= spans["i"]) & (rows["id"] >= spans["i"]), rows["id"].isNull() & spans["i"].isNull())
    return rows.join(spans, (rows["_row"] == spans["r"]) & same_id, "left").select("id", "text", "rest", "spans")


def _kept(data: bytes, cell: pa.Scalar) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal removed runs."""
    spans = merged((s["start"], s["end"]) for s in cell.as_py() or [])
    ends = [0, *(b for _, b in spans)]
    starts = [*(a for a, _ in spans), len(data)]
    return b"".join(data[a:b] for a, b in zip(ends, starts)), spans


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, most: int = MOST_CONTEXTS) -> DataFrame:
    """(id, n_bytes, n_removed, spans array<struct<start,end>>, kept binary) of every row."""
    kind = df.schema[id_col].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, gone, spans, kept = [], [], [], []
            for cell, found in zip(batch.column(1), batch.column(2)):
                data = _as_bytes(cell)
                rest, runs = _kept(data, found)
                size.append(len(data))
                gone.append(len(data) - len(rest))
                spans.append([{"start": a, "end": b} for a, b in runs])
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.binary())],
                names=[id_col, "n_bytes", "n_removed", "spans", "kept"],
            )

    found = _with_spans(df, id_col, text_col, hot, most, []).select("id", "text", "spans")
    return found.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, most: int = MOST_CONTEXTS) -> DataFrame:
    """The input with what is left of each text; characters cut in two go, and a null text is empty."""
    rest = [c for c in df.columns if c not in (id_col, text_col)]

    @F.pandas_udf("string")
    def left(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_left(t, s) for t, s in zip(text, spans)], dtype=object)

    found = _with_spans(df, id_col, text_col, hot, most, rest)
    changed = F.when(F.col("spans").isNull(), F.col("text")).otherwise(left("text", "spans"))
    made = found.select(F.col("id").alias(id_col), changed.alias(text_col), *(F.col("rest")[c].alias(c) for c in rest))
    return made.select(*df.columns)


def _left(text: str, spans: list[dict] | None) -> str:
    data = text.encode("utf-8", "surrogatepass")
    runs = merged((s["start"], s["end"]) for s in (spans if spans is not None else []))
    ends, starts = [0, *(b for _, b in runs)], [*(a for a, _ in runs), len(data)]
    return "".join(data[a:b].decode("utf-8", "ignore") for a, b in zip(ends, starts))


def removal_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, most: int = MOST_CONTEXTS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    made = suffix_dedup(df, id_col, text_col, hot, most)
    return made.select(id_col, "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
