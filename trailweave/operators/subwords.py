"""Subword ids by longest match over a vocabulary table, and batches cut and padded on the left.

A text's words become ids where the text is: nothing but the vocabulary, a bounded table, is sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailweave.functions import arrays

#: A fixed value: what marks a piece that goes on with a word.
MARK = "##"
#: Words of more letters are unknown, as in the usual scheme.
LONGEST = 100
#: Words whose ids a Python process remembers.
REMEMBERED = 400_000


def words(text: Column | str, specials: list[str]) -> Column:
    """Marks like ``<hist>`` as they are, else runs of letters and digits and single signs, in lower case."""
    marks = [f"\\Q{s}\\E" for s in specials]
    found = F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit("|".join([*marks, r"[\p{L}\p{N}]+", r"[^\s\p{L}\p{N}]"])), F.lit(0))
    return F.transform(found, lambda w: F.when(w.isin(*specials), w).otherwise(F.lower(w)) if specials else F.lower(w))


def _longest(tokens: dict[str, int]) -> dict[str, int]:
    """How long the longest token is that begins with given two letters (or is one): it bounds the search."""
    out: dict[str, int] = {}
    for t in tokens:
        out[t[:2]] = max(len(t), out.get(t[:2], 0))
    return out


class Pieces(dict):
    """Ids of words: from the left the longest token that fits. A word that no tokens cover, or that is too long, has the unknown id.

    A word is taken apart when it is first asked for; up to ``REMEMBERED`` words are kept.
    """

    def __init__(self, vocabulary: dict[str, int], specials: dict[str, int], unknown: int, most: int):
        super().__init__({s: (k,) for s, k in specials.items()})
        self.unknown = (unknown,)
        self.begin = {t: k for t, k in vocabulary.items() if 0 < len(t) <= most}
        self.go_on = {t.removeprefix(MARK): k for t, k in vocabulary.items() if t.startswith(MARK) and 0 < len(t) - len(MARK) <= most}
        self.longest = _longest(self.begin), _longest(self.go_on)

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.taken_apart(word) if len(word) <= LONGEST else self.unknown
        if len(self) < REMEMBERED:
            self[word] = found
        return found

    def taken_apart(self, word: str) -> tuple[int, ...]:
        out, at, size = [], 0, len(word)
        tokens, (longest, further) = self.begin, self.longest
        while at < size:
            for end in range(min(size, at + longest.get(word[at : at + 2], 1)), at, -1):
                if (k := tokens.get(word[at:end])) is not None:
                    break
            else:
                return self.unknown
            out.append(k)
            at, tokens, longest = end, self.go_on, further
        return tuple(out)


def encoded(rows: DataFrame, key: str, text: str, vocabulary: DataFrame, specials: dict[str, int], unknown: int, begin: int, most: int = 16) -> DataFrame:
    """(key, ids) of every row, ``begin`` first; ``specials``: marks that are one id each; ``vocabulary``: (token, id), a bounded table of tokens of up to ``most`` letters."""
    tokens = {r.token: r.id for r in vocabulary.select("token", "id").toLocalIterator()}
    sent = rows.sparkSession.sparkContext.broadcast(Pieces(tokens, specials, unknown, most))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = sent.value.__getitem__
        for t in texts:
            yield pd.Series([np.fromiter(chain((begin,), chain.from_iterable(map(of, x.split(" "))) if x else ()), np.int64) for x in t], dtype=object)

    # no word has a space in it, so that a text's words can cross as one string
    return rows.select(F.col(key), ids(F.array_join(words(text, list(specials)), " ")).alias("ids"))


def left_batches(rows: DataFrame, batch: str, most: int, fill: int) -> DataFrame:
    """Rows (.., ids, ``batch``) with the last ``most`` ids, padded on the left to the longest of their batch, and the mask of what is their own."""
    cut = rows.withColumn("ids", arrays.last_tokens(F.col("ids"), most))
    wide = cut.withColumn("_wide", F.max(F.size("ids")).over(Window.partitionBy(batch)))
    rest = F.col("_wide") - F.size("ids")
    made = wide.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(False), rest), F.array_repeat(F.lit(True), F.size("ids"))))
    return made.withColumn("input_ids", arrays.padded(F.col("ids"), F.col("_wide"), F.lit(fill).cast("long"), left=True)).drop("_wide")
