"""Array and string expressions that Spark has no name for."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A fixed value: the characters that Unicode has as white space, as a class that Java and SQL engines read alike.
SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def words(text: Column | str) -> Column:
    """Non-empty runs between Unicode white space; none for an empty text."""
    return F.filter(F.split(text, f"{SPACES}+"), lambda w: w != "")


def spaced(text: Column | str) -> Column:
    """Parts between single spaces; empty parts stay."""
    return F.split(text, " ", -1)


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """What ``make`` makes of a value that is worked out once: an expression named inside a lambda is worked out anew for every element."""
    return F.transform(F.array(value), make)[0]


def ngrams(tokens: Column, n: int) -> Column:
    """All windows of n tokens, each joined by spaces; none if there are fewer tokens."""
    windows = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda k: F.array_join(F.slice(t, k, n), " "))
    return bound(tokens, lambda t: F.when(F.size(t) >= n, windows(t)).otherwise(F.array().cast("array<string>")))


def _common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a bit for each of b's tokens: one addition per token of a."""
    at: dict[str, int] = {}
    for k, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1
    rows = full
    for x in a:
        hit = rows & at.get(x, 0)
        rows = (rows + hit | rows - hit) & full
    return len(b) - rows.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two arrays of tokens."""
    return pd.Series([_common_subsequence(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def lcs_lengths(many: pd.Series, one: pd.Series) -> pd.Series:
    """The same of each of an array's texts and one text, both cut at single spaces."""
    return pd.Series([[_common_subsequence(t.split(" "), y) for t in x] for x, y in zip(many, one.str.split(" "))], dtype=object)


def run_lengths(chunks: Column | str) -> Column:
    """[[from, to], ...] -> the chunk's number repeated for each of its steps."""
    return F.flatten(F.transform(chunks, lambda c, k: F.array_repeat(k, (c[1] - c[0]).cast("int"))))


def _as_size(size: Column | int) -> Column:
    return F.lit(size) if isinstance(size, int) else size


def padded(values: Column, size: Column | int, fill: Column, left: bool = False) -> Column:
    """An array filled up to ``size`` at the end, or at the beginning."""
    rest = F.array_repeat(fill, F.greatest(F.lit(0), _as_size(size) - F.size(values)))
    return F.concat(rest, values) if left else F.concat(values, rest)


def length_mask(values: Column, size: Column | int, left: bool = False) -> Column:
    """True where an array padded to ``size`` has a value of its own."""
    n = _as_size(size)
    own = (lambda k: k >= n - F.size(values)) if left else (lambda k: k < F.size(values))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), own)).otherwise(F.array().cast("array<boolean>"))


def last_tokens(values: Column, most: int) -> Column:
    """The last ``most`` of an array: what is left when it is cut on the left."""
    return F.slice(values, F.greatest(F.size(values) - most, F.lit(0)) + 1, most)


def first_words(text: Column | str, n: int) -> Column:
    """The first n words joined by spaces; shorter texts as they are."""
    found = words(text)
    return F.when(F.size(found) > n, F.array_join(F.slice(found, 1, n), " ")).otherwise(F.col(text) if isinstance(text, str) else text)


def stripped(text: Column | str) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, rf"\A{SPACES}+|{SPACES}+\z", "")


def one_line(text: Column | str) -> Column:
    """A text for line protocols: breaks, tabs and field marks as spaces, collapsed; an empty one is one space."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\n\r\t]|\|\|\|", " "), r"\s+", " "))
    return F.when(flat == "", " ").otherwise(flat)


# Tokens that count as punctuation.
PUNCTUATION = ("''", "'", "``", "`", "-LRB-", "-RRB-", "-LCB-", "-RCB-", ".", "?", "!", ",", ":", "-", "--", "...", ";")


def without_punctuation(tokens: Column) -> Column:
    """Tokens that are no punctuation."""
    return F.filter(tokens, lambda t: ~t.isin(*PUNCTUATION))


def truth(text: Column | str) -> Column:
    """A word for yes or no as a boolean; others raise."""
    low = F.lower(text)
    # fixed values
    yes, no = low.isin("yes", "true", "t", "y", "1"), low.isin("no", "false", "f", "n", "0")
    return F.when(yes, F.lit(True)).when(no, F.lit(False)).otherwise(F.raise_error(F.lit("a boolean is expected")).cast("boolean"))


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores."""
    top = F.array_max(scores)
    raised = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(raised, lambda e: e / F.aggregate(raised, F.lit(0.0), lambda a, x: a + x))


def entropy(probabilities: Column) -> Column:
    """Of an array of probabilities, in nats."""
    return F.aggregate(probabilities, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(0.0))


def argmax(scores: Column) -> Column:
    """Index from 0 of the first greatest value; null for none."""
    return F.when(F.size(scores) > 0, F.array_position(scores, F.array_max(scores)) - 1)


def mean_vector(vectors: Column, size: int) -> Column:
    """Element-wise mean of an array of equally long arrays; null for none."""
    zero = F.array_repeat(F.lit(0.0), size)
    total = F.aggregate(vectors, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.when(F.size(vectors) > 0, F.transform(total, lambda x: x / F.size(vectors)))


# The rules of Penn Treebank tokens for English, taken in this order. Groups are written \1; no rule looks around itself, so
# that Java and SQL engines read the patterns alike.
TREEBANK = (
    (r"[\t\n\x0b\f\r ]+", " "),
    (r"^\"|([ (\[{<])\"", "\\1 `` "),
    (r"\"", " '' "),
    (r"\.\.\.", " ... "),
    (r"([;@#$%&?!])", " \\1 "),
    (r"([,:])([^0-9])", " \\1 \\2"),
    (r"([,:])$", " \\1 "),
    (r"([^ .])(\.)([)\]}>' ]*)$", "\\1 \\2\\3 "),
    (r"([a-z)][a-z)])(\.) ", "\\1 \\2 "),
    (r"\(", " -LRB- "), (r"\)", " -RRB- "), (r"\{", " -LCB- "), (r"\}", " -RCB- "), (r"\[", " -LSB- "), (r"\]", " -RSB- "),
    (r"--+", " -- "),
    (r" ", "  "),
    (r"([A-Za-z])(n't|N'T)( |$)", "\\1 \\2\\3"),
    (r"([A-Za-z0-9])('(?:s|S|m|M|d|D|ll|LL|re|RE|ve|VE))( |$)", "\\1 \\2\\3"),
    (r"([^ '])'( |$)", "\\1 '\\2"),
    (r"(^| )([Cc]an)(not)( |$)", "\\1\\2 \\3\\4"), (r"(^| )([Gg]on|[Ww]an)(na)( |$)", "\\1\\2 \\3\\4"), (r"(^| )([Gg]ot)(ta)( |$)", "\\1\\2 \\3\\4"),
    (r"(^| )([Gg]im|[Ll]em)(me)( |$)", "\\1\\2 \\3\\4"), (r"(^| )('[Tt])(is|was)( |$)", "\\1\\2 \\3\\4"),
    (r" +", " "),
)


def treebank(text: Column | str) -> Column:
    """Penn Treebank tokens in lower case: the rules one after another, as one expression."""
    out = F.col(text) if isinstance(text, str) else text
    for pattern, by in TREEBANK:
        out = F.regexp_replace(out, pattern, by.replace("\\", "$"))
    return F.filter(F.split(F.lower(out), " "), lambda w: w != "")
