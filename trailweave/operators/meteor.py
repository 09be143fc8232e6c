"""METEOR in its exact and stem form: one-to-one word alignments, a harmonic mean, a penalty for fragments.

Tokens, stems, classes of words, sums and scores are DataFrame expressions; the alignment of one pair, a
search, is a small vectorised function over the pairs of a task. Stems are made once a distinct word. Words of
the references that are more than ``FREQUENT`` of all are function words (so there are fewer than
1 / FREQUENT of them, a bounded set to broadcast).

Synonyms and paraphrases are left out: their tables are not public data of this library.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.operators.stemming import stems
from trailweave.sources.durable import durable
from trailweave.sources.spread import spread

# Fixed values of the score's definition for English.
ALPHA, BETA, GAMMA, DELTA = 0.85, 0.2, 0.6, 0.75
EXACT, STEM = 1.0, 0.6
FREQUENT = 0.001
BEAM = 40


def tokens(text: Column | str) -> Column:
    """Words and single signs, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+(?:'[\p{L}]+)?|[^\s\p{L}\p{N}]"), F.lit(0))


def aligned(hyp: Sequence[str], hyp_stems: Sequence[str], ref: Sequence[str], ref_stems: Sequence[str], beam: int = BEAM) -> list[tuple[int, int]]:
    """(place in hyp, place in ref) pairs, one to one: most words, then fewest chunks, then shortest distances.

    Words that can only match each other are matched at once. The rest is searched from left to right, the best
    ``beam`` partial alignments going on; with a beam as large as their number the search is exact.
    """
    at: dict[str, list[int]] = {}
    for j, s in enumerate(ref_stems):
        at.setdefault(s, []).append(j)
    rivals: dict[str, int] = {}
    for s in hyp_stems:
        rivals[s] = rivals.get(s, 0) + 1
    # a score is one number that orders like (matched, -chunks, -distance, -stem matches)
    most = max(len(hyp), len(ref)) + 1
    far = most + 1
    chunk = far * (most * most + 1)
    word = chunk * (most + 1)
    # score, used places, last place, pairs as a linked list; the best first, of equals the one made first
    states: list[tuple[int, int, int, tuple | None]] = [(0, 0, -2, None)]
    broken, alike, i = True, True, 0  # no last word was matched; no two states used the same places
    while i < len(hyp_stems):
        places = at.get(hyp_stems[i])
        if not places:
            broken, i = True, i + 1
            continue
        forced = len(places) == rivals[hyp_stems[i]] == 1
        # of states that used the same places the first is the best: the others only matter where they go on with a chunk
        if alike:
            members = [[s] for s in states]
        else:
            groups: dict[int, list] = {}
            for s in states:
                groups.setdefault(s[1], []).append(s)
            members = list(groups.values())
        if forced:
            # what follows is the same for all states, as far as words can only match each other
            j = places[0]
            delta, bit, more, to = word - chunk - far * abs(i - j) - (hyp[i] != ref[j]), 1 << j, [(i, j)], j
            while i + len(more) < len(hyp_stems):
                k = i + len(more)
                after = at.get(hyp_stems[k])
                if not after or not len(after) == rivals[hyp_stems[k]] == 1:
                    break
                delta += word - chunk * (after[0] != to + 1) - far * abs(k - after[0]) - (hyp[k] != ref[after[0]])
                to = after[0]
                bit |= 1 << to
                more.append((k, to))
            made_states, goes_on = [], False
            for group in members:
                score, used, _, way = group[0]
                if not broken and j:
                    for other, _, last, its in group:
                        if last == j - 1 and other + chunk > score:
                            score, way, goes_on = other + chunk, its, True
                made_states.append((score + delta, used | bit, to, (more, way)))
            if goes_on:
                made_states.sort(key=itemgetter(0), reverse=True)
            states, broken, alike, i = made_states, False, True, i + len(more)
            continue
        # a candidate is one number: its score, then minus its rank of making (group and place); the least that may stay is known early
        width = len(places) + 1
        bits = (len(members) * width).bit_length()
        low = (1 << bits) - 1
        steps = [((word - chunk - far * abs(i - j) - (hyp[i] != ref[j])) << bits) - k for k, j in enumerate(places)]
        order = sorted(zip(steps, [1 << j for j in places], range(len(places))), reverse=True)
        made: list[int] = []
        goes: dict[int, tuple | None] = {}
        if not broken:
            rank_of = {j - 1: k for k, j in enumerate(places) if j}
            for g, group in enumerate(members):
                for other, used, last, way in group:
                    if last in rank_of and other + chunk > group[0][0] and not used >> last + 1 & 1:
                        k = rank_of[last]
                        made.append((other + chunk << bits) + low - g * width + steps[k])
                        goes[g * width + k] = way
        least, top = None, order[0][0]
        for g, group in enumerate(members):
            score, used = group[0][:2]
            base = (score << bits) + low - g * width
            if least is not None and base + top < least:
                break
            for d, bit, k in order:
                if not used & bit and (not goes or g * width + k not in goes):
                    x = base + d
                    if least is not None and x < least:
                        break
                    made.append(x)
            x = base - width + 1  # the word stays alone
            if least is None or x > least:
                made.append(x)
            if len(made) >= beam + 16:
                made.sort(reverse=True)
                del made[beam:]
                least = made[-1]
        made.sort(reverse=True)
        states = []
        for x in made[:beam]:
            rank = low - (x & low)
            g, k = divmod(rank, width)
            _, used, _, way = members[g][0]
            if k == width - 1:
                states.append((x >> bits, used, -2, way))
            else:
                j = places[k]
                states.append((x >> bits, used | 1 << j, j, ([(i, j)], goes.get(rank, way))))
        broken, alike, i = False, False, i + 1
    way, parts = states[0][3], []
    while way:
        parts.append(way[0])
        way = way[1]
    return [p for part in reversed(parts) for p in part]


def chunks(pairs: Sequence[tuple[int, int]]) -> int:
    """Runs of pairs that follow each other on both sides."""
    return sum(k == 0 or (pairs[k - 1][0] + 1, pairs[k - 1][1] + 1) != p for k, p in enumerate(pairs))


_COUNTS = "hyp_content long, hyp_function long, ref_content long, ref_function long, content double, function double, ref_content_matched double, ref_function_matched double, matched long, chunks long"
COUNTS = [c.split()[0] for c in _COUNTS.split(", ")]


def _tokens(rows: DataFrame) -> DataFrame:
    """(id, texts): the tokens of the hypothesis, then of each reference. Read several times, so written once, dealt to enough tasks for a search in every row."""
    texts = F.transform(F.concat(F.array("hyp"), "refs"), lambda t: tokens(t))
    return durable(spread(rows.select("id", "hyp", "refs"), "id").select("id", texts.alias("texts")))


def _frequent(texts: DataFrame) -> set[str]:
    """The function words, fewer than 1 / ``FREQUENT``."""
    refs = texts.select(F.explode(F.flatten(F.slice("texts", 2, F.size("texts")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    refs = durable(refs)
    total = refs.agg(F.sum("n").alias("total"))  # one row
    return {r.word for r in refs.crossJoin(F.broadcast(total)).where(F.col("n") > FREQUENT * F.col("total")).select("word").collect()}


def _with_stems(texts: DataFrame) -> DataFrame:
    """(id, texts, stems): of an id's words those that their stem differs from, as a map. Each distinct word is stemmed once."""
    words = texts.select("id", F.explode(F.array_distinct(F.flatten("texts"))).alias("word"))
    known = durable(durable(stems(spread(words.select("word").distinct(), "word"))).where("stem <> word"))  # a filter on stems would be worked out apart from them
    of = words.join(known, "word").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("word", "stem"))).alias("stems"))
    return spread(texts.join(of, "id", "left"), "id")


def counts(rows: DataFrame, beam: int = BEAM, stemmed: bool = True) -> DataFrame:
    """(id, of, counts) of every hypothesis with each of its references: rows (id, hyp, refs). Unless ``stemmed`` only equal words match."""
    texts = _tokens(rows)
    often = _frequent(texts)
    flat = _with_stems(texts) if stemmed else texts.withColumn("stems", F.lit(None).cast("map<string,string>"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, held, other in zip(f["id"], f["texts"], f["stems"]):
                if held is None:
                    continue
                stem = dict(other) if other is not None else {}
                hw, *refs = (list(t) for t in held)
                hs, hf = [stem.get(w, w) for w in hw], [w in often for w in hw]
                for of, rw in enumerate(refs, 1):
                    rf = [w in often for w in rw]
                    found = aligned(hw, hs, rw, [stem.get(w, w) for w in rw], beam)
                    weights = [EXACT if hw[i] == rw[j] else STEM for i, j in found]
                    own = [sum(w for (i, _), w in zip(found, weights) if hf[i] == k) for k in (False, True)]
                    others = [sum(w for (_, j), w in zip(found, weights) if rf[j] == k) for k in (False, True)]
                    out.append((key, of, len(hf) - sum(hf), sum(hf), len(rf) - sum(rf), sum(rf), *own, *others, len(found), chunks(found)))
            yield pd.DataFrame(out, columns=["id", "of", *COUNTS])

    kind = rows.schema["id"].dataType.simpleString()
    return flat.mapInPandas(run, f"id {kind}, of int, {_COUNTS}")


def equal_counts(rows: DataFrame) -> DataFrame:
    """The counts of equal words alone, without chunks: a word is matched as often as both sides have it, so nothing is searched."""
    texts = _tokens(rows)
    often = _frequent(texts)
    names = [c for c in COUNTS if c != "chunks"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, held in zip(f["id"], f["texts"]):
                if held is None:
                    continue
                hyp, *refs = (Counter(t) for t in held)
                parts = lambda c: [sum(n for w, n in c.items() if (w in often) == k) for k in (False, True)]
                for of, ref in enumerate(refs, 1):
                    both = parts(hyp & ref)
                    out.append((key, of, *parts(hyp), *parts(ref), *map(float, both * 2), sum(both)))
            yield pd.DataFrame(out, columns=["id", "of", *names])

    kind = rows.schema["id"].dataType.simpleString()
    return texts.mapInPandas(run, f"id {kind}, of int, " + ", ".join(c for c in _COUNTS.split(", ") if c.split()[0] in names))


def score() -> Column:
    """The score of counts, or of their sums."""
    c = {n: F.col(n).cast("double") for n in COUNTS}
    size = lambda side: DELTA * c[f"{side}_content"] + (1 - DELTA) * c[f"{side}_function"]
    share = lambda hit, of: F.when(of > 0, hit / of).otherwise(0.0)
    p = share(DELTA * c["content"] + (1 - DELTA) * c["function"], size("hyp"))
    r = share(DELTA * c["ref_content_matched"] + (1 - DELTA) * c["ref_function_matched"], size("ref"))
    mean = F.when((p > 0) & (r > 0), p * r / (ALPHA * p + (1 - ALPHA) * r)).otherwise(0.0)
    whole = (c["chunks"] == 1) & (c["matched"] == c["hyp_content"] + c["hyp_function"]) & (c["matched"] == c["ref_content"] + c["ref_function"])
    penalty = F.when(whole | (c["matched"] == 0), 0.0).otherwise(GAMMA * F.pow(c["chunks"] / F.greatest(c["matched"], F.lit(1.0)), F.lit(BETA)))
    return mean * (1 - penalty)


def best(counted: DataFrame) -> DataFrame:
    """(id, meteor, counts): each id with the reference that gives it the highest score, of equal ones the first."""
    scored = counted.withColumn("meteor", score())
    top = scored.groupBy("id").agg(F.max(F.struct("meteor", (-F.col("of")).alias("first"), *COUNTS)).alias("b"))
    return top.select("id", F.col("b.meteor").alias("meteor"), *(F.col(f"b.{c}").alias(c) for c in COUNTS))


def corpus(chosen: DataFrame) -> DataFrame:
    """One row: the score of the summed counts of ``best``. Parts of a corpus may be united before."""
    return chosen.agg(*(F.sum(c).alias(c) for c in COUNTS)).select(score().alias("meteor"))
