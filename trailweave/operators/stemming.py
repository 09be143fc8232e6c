"""English stems by ordered suffix rules, as expressions over a column of distinct words.

The rules are those of the published Snowball algorithm for English. Each step is a projection with one chain of
conditions, longest suffix first; regions of a word are held as positions, so a rule asks for a region
by comparing numbers. Words are stemmed once each: ``stems`` takes the distinct words of a corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOWEL = "[aeiouy]"
OTHER = "[^aeiouy]"

# Fixed values of the algorithm: whole words, beginnings with a region of their own, and suffixes.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
STAYS = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
BEGINNINGS = "gener|commun|arsen"
DOUBLES = "bb|dd|ff|gg|mm|nn|pp|rr|tt"
SECOND = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
THIRD = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
FOURTH = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")


def _cut(w: Column, n: int, add: str = "") -> Column:
    """The word without its last n letters, and with others."""
    kept = F.substring(w, F.lit(1), F.length(w) - n)
    return F.concat(kept, F.lit(add)) if add else kept


def _first(w: Column, rules: list[tuple[str, Callable[[Column, int], Column]]]) -> Column:
    """What the longest suffix that fits does with the word; others are not tried, even if it does nothing."""
    out = None
    for suffix, what in sorted(rules, key=lambda r: -len(r[0])):
        out = (F if out is None else out).when(w.endswith(suffix), what(w, len(suffix)))
    return out.otherwise(w)


def _in(region: str, add: str = "", more: Callable[[Column], Column] | None = None) -> Callable[[Column, int], Column]:
    """Replace the suffix where it lies in a region, and ``more`` holds of what is before it."""

    def what(w: Column, n: int) -> Column:
        ok = F.length(w) - n >= F.col(region)
        return F.when(ok & more(_cut(w, n)) if more else ok, _cut(w, n, add)).otherwise(w)

    return what


def _short_end(w: Column) -> Column:
    """Whether a word ends in a short syllable."""
    return w.rlike(rf"({OTHER}{VOWEL}[^aeiouywxY]|^{VOWEL}{OTHER})$")


def _mended(w: Column) -> Column:
    """After a cut of -ed or -ing: an e comes back, or one of two like letters goes."""
    return F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(f"({DOUBLES})$"), _cut(w, 1)).when(_short_end(w) & (F.length(w) <= F.col("r1")), F.concat(w, F.lit("e"))).otherwise(w)


def stems(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, stem) of a column of distinct words in lower case."""
    w = F.col("w")
    long = words.select(F.col(word).alias("word"), F.regexp_replace(word, "^'", "").alias("w"))
    df = long.withColumn("w", F.regexp_replace(w, f"^y|(?<={VOWEL})y", "Y"))
    # y that stands for a consonant is Y; a region begins after the first consonant behind a vowel
    region = lambda text: F.when(text.rlike(f"{VOWEL}{OTHER}"), F.length(F.regexp_extract(text, f"^.*?{VOWEL}{OTHER}", 0))).otherwise(F.length(text))
    own = F.length(F.regexp_extract(w, f"^({BEGINNINGS})", 0))
    df = df.withColumn("r1", F.when(own > 0, own).otherwise(region(w)))
    df = df.withColumn("r2", F.col("r1") + region(F.substring(w, F.col("r1") + 1, F.length(w))))
    df = df.withColumn("w", F.regexp_replace(w, "('s'|'s|')$", ""))

    ie = lambda x, n: F.when(F.length(x) > n + 1, _cut(x, n, "i")).otherwise(_cut(x, n, "ie"))
    plural = lambda x, n: F.when(x.rlike(f"{VOWEL}.+s$"), _cut(x, n)).otherwise(x)
    same = lambda x, n: x
    df = df.withColumn("w", _first(w, [("sses", lambda x, n: _cut(x, 2)), ("ied", ie), ("ies", ie), ("us", same), ("ss", same), ("s", plural)]))
    df = df.withColumn("done", w.isin(*STAYS))

    past = lambda x, n: F.when(_cut(x, n).rlike(VOWEL), F.concat(_cut(x, n), F.lit("*"))).otherwise(x)
    df = df.withColumn("w1", _first(w, [("eed", _in("r1", "ee")), ("eedly", _in("r1", "ee")), *((s, past) for s in ("ed", "edly", "ing", "ingly"))]))
    df = df.withColumn("cut", F.col("w1").endswith("*")).withColumn("w1", F.when(F.col("cut"), _cut(F.col("w1"), 1)).otherwise(F.col("w1")))
    df = df.withColumn("w1", F.when(F.col("cut"), _mended(F.col("w1"))).otherwise(F.col("w1")))

    x = F.col("w1")
    df = df.withColumn("w1", F.when(x.rlike(f"^.+{OTHER}[yY]$"), _cut(x, 1, "i")).otherwise(x))
    li = _in("r1", "", lambda before: before.rlike("[cdeghkmnrt]$"))
    df = df.withColumn("w1", _first(x, [*((s, _in("r1", r)) for s, r in SECOND.items()), ("ogi", _in("r1", "og", lambda before: before.endswith("l"))), ("li", li)]))
    df = df.withColumn("w1", _first(x, [*((s, _in("r1", r)) for s, r in THIRD.items()), ("ative", _in("r2"))]))
    df = df.withColumn("w1", _first(x, [*((s, _in("r2")) for s in FOURTH), ("ion", _in("r2", "", lambda before: before.rlike("[st]$")))]))
    no_e = (F.length(x) - 1 >= F.col("r2")) | (F.length(x) - 1 >= F.col("r1")) & ~_short_end(_cut(x, 1))
    df = df.withColumn("w1", F.when(x.endswith("e"), F.when(no_e, _cut(x, 1)).otherwise(x)).when(x.endswith("ll") & (F.length(x) - 1 >= F.col("r2")), _cut(x, 1)).otherwise(x))

    fixed = F.create_map(*(F.lit(v) for kv in WHOLE.items() for v in kv))
    stem = F.coalesce(F.try_element_at(fixed, F.col("word")), F.when(F.length("word") <= 2, F.col("word")).otherwise(F.lower(F.when(F.col("done"), w).otherwise(x))))
    return df.select("word", stem.alias("stem"))
