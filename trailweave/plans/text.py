"""Text score queries: hypotheses are assistants' turns, references the users' turns before them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.functions import arrays
from trailweave.operators import annotate, meteor, subwords
from trailweave.operators import textmetrics as M
from trailweave.plans.base_sql import words_sql
from trailweave.sources.tables import table

#: References of a pair.
REFS = 2


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(id, hyp, refs): the reply and, as references, the turn before it and its own words, all but the first six in reverse order."""
    t = table(spark, sf, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn")
    r = t.select("conv_id", "turn", "role", "text", F.lag("role").over(before).alias("role0"), F.lag("text").over(before).alias("text0"))
    r = r.where("role = 'assistant' AND role0 = 'user'").withColumn("w", arrays.words("text"))
    join = lambda a: F.array_join(a, " ")
    turned = F.concat(F.slice("w", 1, 6), F.reverse(F.slice("w", 7, F.greatest(F.size("w"), F.lit(1)))))
    return r.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), join("w").alias("hyp"), F.array(join(arrays.words("text0")), join(turned)).alias("refs"))


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c not in names), *(F.round(F.col(c), 6).alias(c) for c in names))


def txt01_bleu_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """BLEU-1..4 of all pairs together."""
    return _six(M.bleu_corpus(M.bleu_counts(pairs(spark, sf), most_refs=REFS)), "bleu1", "bleu2", "bleu3", "bleu4", "reflen")


def txt02_bleu_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """BLEU-1..4 of every pair."""
    return _six(M.bleu_sentences(M.bleu_counts(pairs(spark, sf), most_refs=REFS)), "bleu1", "bleu2", "bleu3", "bleu4")


def txt03_bleu_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Reference lengths by the three options."""
    p = pairs(spark, sf).withColumn("n", F.size(arrays.words("hyp"))).withColumn("sizes", F.transform("refs", lambda r: F.size(arrays.words(r))))
    return p.select("id", *(M.reference_length(F.col("n"), F.col("sizes"), o).alias(o) for o in ("closest", "shortest", "average")))


def agg21_merged_counts(spark: SparkSession, sf: str) -> DataFrame:
    """BLEU of two halves' counts merged: equal to that of the whole."""
    p = pairs(spark, sf)
    halves = [M.bleu_counts(p.where(F.col("id") % 2 == k)) for k in (0, 1)]
    return _six(M.bleu_corpus(halves[0].unionByName(halves[1])), "bleu1", "bleu2", "bleu3", "bleu4", "reflen")


def txt04_rouge_l(spark: SparkSession, sf: str) -> DataFrame:
    """ROUGE-L of every pair."""
    return _six(M.rouge_l(pairs(spark, sf)), "rouge_l")


def arr04_lcs(spark: SparkSession, sf: str) -> DataFrame:
    """Longest common subsequence of each reply and the turn before."""
    return pairs(spark, sf).select("id", arrays.lcs_length(arrays.spaced("hyp"), arrays.spaced(F.col("refs")[0])).alias("lcs"))


def txt05_cider(spark: SparkSession, sf: str) -> DataFrame:
    """CIDEr of every pair."""
    return _six(M.cider(pairs(spark, sf), most_refs=REFS), "cider")


def txt06_cider_given_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """CIDEr with document frequencies of the benchmark's passages."""
    refs = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.array("text").alias("refs"))
    return _six(M.cider(pairs(spark, sf), M.document_frequency(refs), 1000.0, REFS), "cider")


def agg14_document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """In how many ids' references each n-gram occurs."""
    return M.document_frequency(pairs(spark, sf))


def txt07_meteor(spark: SparkSession, sf: str) -> DataFrame:
    """METEOR (exact and stem) of every pair, with the words matched and their chunks."""
    return meteor.best(meteor.counts(pairs(spark, sf))).select("id", F.round("meteor", 9).alias("meteor"), "matched", "chunks")


def txt07_meteor_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """METEOR of all pairs together."""
    return meteor.corpus(meteor.best(meteor.counts(pairs(spark, sf)))).select(F.round("meteor", 9).alias("meteor"))


def txt07_exact_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What METEOR counts of equal words for every pair and reference: content and function words of both sides, and those matched."""
    c = meteor.equal_counts(pairs(spark, sf))
    whole = ["content", "function", "ref_content_matched", "ref_function_matched"]
    return c.select("id", F.col("of").alias("ref"), *(F.col(n).cast("long").alias(n) for n in whole), "hyp_content", "hyp_function", "ref_content", "ref_function", "matched")


def txt08_exact_match(spark: SparkSession, sf: str) -> DataFrame:
    """The share of replies that are one of their references, every third having itself among them."""
    p = pairs(spark, sf)
    p = p.withColumn("refs", F.when(F.col("id") % 3 == 0, F.array_append("refs", F.col("hyp"))).otherwise(F.col("refs")))
    return M.exact_match(p).agg(F.round(F.avg("em") * 100, 6).alias("em"), F.count(F.lit(1)).alias("n"))


def txt09_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """All scores as rows."""
    return M.bundle(pairs(spark, sf)).select("metric", F.round("value", 3).alias("value"))


def txt12_masked_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of each reply (word lengths as ids), its first four words being the prompt."""
    ids = F.transform(arrays.words("hyp"), lambda w: F.length(w))
    seg = F.transform(arrays.words("hyp"), lambda w, k: (k >= 4).cast("int"))
    p = pairs(spark, sf).select("id", ids.alias("ids"), seg.alias("seg"))
    return p.select("id", F.array_join(F.transform(M.masked_labels("ids", "seg"), lambda x: x.cast("string")), ",").alias("labels"))


def agg20_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Summed loss of rows whose label counts."""
    rows = table(spark, sf, "labels").select(F.when(F.col("toxic") == 1, -100).otherwise(F.col("quality")).alias("label"), (-(F.col("doc_id") % 10) / 10.0).alias("lp"))
    return M.cross_entropy(rows, "label", "lp").select(F.round("loss", 6).alias("loss"))


def str_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Words, parts between single spaces, and n-grams of every turn."""
    t = table(spark, sf, "conversations")
    w = arrays.words("text")
    return t.select("conv_id", "turn", F.size(w).alias("n_words"), F.size(arrays.spaced("text")).alias("n_parts"), F.size(arrays.ngrams(w, 3)).alias("n_trigrams"), F.md5(arrays.one_line("text")).alias("line_md5"))


#: What stands around the texts of the queries of tokens, so that every rule has something to do.
QUOTED = ' He\'d said: "we can\'t (or won\'t) pay 1,000 dollars; isn\'t it 3:30 -- gonna cannot cannot..." [John\'s], \'tis 50% {so}. '


def str06_treebank(spark: SparkSession, sf: str) -> DataFrame:
    """Treebank tokens of every turn with some quoted speech, and what is left of them without punctuation."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", arrays.treebank(F.concat(F.lit(QUOTED), "text", F.lit(QUOTED))).alias("w"))
    made = lambda w: F.md5(F.array_join(w, " "))
    return t.select("conv_id", "turn", F.size("w").alias("n"), made("w").alias("md5"), made(arrays.without_punctuation(F.col("w"))).alias("plain_md5"))


#: Marks that are one id each, and the other ids that are no tokens.
SPECIALS = {"<cand>": 4, "<hist>": 5, "<obj>": 6}
PAD, BEGIN, UNKNOWN, FIRST_ID = 0, 1, 2, 10
#: Ids that a document keeps, the last ones.
MOST_IDS = 1024


def _vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """(token, id): words of the benchmark's passages, and the parts of up to three letters that they begin or go on with; ids by order.

    A vocabulary is a bounded table, so that it is put in order as a whole.
    """
    w = table(spark, sf, "benchmark").select(F.explode(subwords.words("text", [])).alias("w")).distinct().where(F.length("w") <= 16)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.length("w")), lambda a: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.struct(a.alias("a"), n.alias("n")))))
    each = w.select("w", F.explode(spans).alias("s")).select("w", "s.a", "s.n").where(F.col("a") + F.col("n") - 1 <= F.length("w"))
    part = F.substring(F.col("w"), F.col("a"), F.col("n"))
    tokens = each.select(F.when(F.col("a") > 1, F.concat(F.lit(subwords.MARK), part)).otherwise(part).alias("token")).union(w.select("w")).distinct()
    return tokens.select("token", (F.row_number().over(Window.orderBy("token")) + F.lit(FIRST_ID)).cast("long").alias("id"))


def txt13_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as subword ids, marks among them, cut on the left to 1024 and padded on the left to the longest of their batch of 32."""
    marked = F.concat(F.lit("<hist> "), F.coalesce("text", F.lit("")), F.lit(" <cand><obj>"))
    docs = table(spark, sf, "documents").select("doc_id", marked.alias("text"))
    ids = subwords.encoded(docs, "doc_id", "text", _vocabulary(spark, sf), SPECIALS, UNKNOWN, BEGIN)
    ids = ids.select("doc_id", arrays.last_tokens(F.col("ids"), MOST_IDS).alias("ids"))  # the rest is cut anyway, so it need not cross
    b = annotate.numbered(ids, "doc_id", [], width=10_000).withColumn("batch", F.floor(F.col("sample_idx") / 32))
    made = lambda c: F.md5(F.array_join(F.col(c).cast("array<int>").cast("array<string>"), ","))
    out = subwords.left_batches(b, "batch", MOST_IDS, PAD)
    return out.select("doc_id", "batch", F.size("ids").alias("n"), F.size("input_ids").alias("width"), made("input_ids").alias("ids_md5"), made("attention_mask").alias("mask_md5"))


def prj12_first_words(spark: SparkSession, sf: str) -> DataFrame:
    """Documents cut to 128 words where they are longer."""
    cut = arrays.first_words("text", 128)
    return table(spark, sf, "documents").select("doc_id", F.length(cut).alias("n_chars_cut"), F.md5(cut).alias("md5"))


QUERIES = {
    f.__name__: f
    for f in (
        txt01_bleu_corpus, txt02_bleu_sentences, txt03_bleu_lengths, agg21_merged_counts, txt04_rouge_l, arr04_lcs, txt05_cider, txt06_cider_given_frequency,
        agg14_document_frequency, txt07_meteor, txt07_meteor_corpus, txt07_exact_counts, txt08_exact_match, txt09_bundle, txt12_masked_labels, agg20_cross_entropy, str_tokens, str06_treebank, txt13_tokens, prj12_first_words,
    )
}

PAIRS = f"""
turns AS (SELECT conv_id, turn, role, {words_sql("text")} AS w, lag(role) OVER p AS role0, lag({words_sql("text")}) OVER p AS w0
  FROM conversations WINDOW p AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS MATERIALIZED (SELECT conv_id * 1000 + turn AS id, array_to_string(w, ' ') AS hyp,
    [array_to_string(w0, ' '), array_to_string(list_concat(w[1:6], list_reverse(w[7:])), ' ')] AS refs
  FROM turns WHERE role = 'assistant' AND role0 = 'user')"""
GRAMS = f"""{PAIRS},
h AS (SELECT id, {words_sql("hyp")} AS t FROM pairs),
r AS (SELECT id, unnest(range(1, 3)) AS ref, {words_sql("unnest(refs)")} AS t FROM pairs),
ks AS (SELECT unnest([1, 2, 3, 4]) AS k),
hg AS (SELECT id, k, array_to_string(t[i:i+k-1], ' ') AS gram, count(*) AS n FROM (SELECT id, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM h, ks) GROUP BY 1, 2, 3),
rg AS (SELECT id, ref, k, array_to_string(t[i:i+k-1], ' ') AS gram, count(*) AS n FROM (SELECT id, ref, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM r, ks) GROUP BY 1, 2, 3, 4)"""
_COUNTS = f"""{GRAMS},
hits AS (SELECT g.id, g.k, sum(least(g.n, m.most)) AS c FROM hg g JOIN (SELECT id, k, gram, max(n) AS most FROM rg GROUP BY 1, 2, 3) m USING (id, k, gram) GROUP BY 1, 2),
sizes AS (SELECT h.id, len(h.t) AS testlen, arg_min(len(r.t), abs(len(r.t) - len(h.t)) * 100000 + len(r.t)) AS closest, min(len(r.t)) AS shortest, avg(len(r.t)) AS average
  FROM h JOIN r USING (id) GROUP BY h.id, h.t),
counts AS (SELECT s.id, s.testlen, CAST(s.closest AS DOUBLE) AS reflen,
    {", ".join(f"greatest(0, testlen - {k - 1}) AS g{k}, coalesce((SELECT c FROM hits x WHERE x.id = s.id AND x.k = {k}), 0) AS c{k}" for k in (1, 2, 3, 4))}
  FROM sizes s)"""


def _bleu_sql(prefix: str) -> str:
    brevity = f"CASE WHEN ({prefix}testlen + 1e-15) / ({prefix}reflen + 1e-9) < 1 THEN exp(1 - 1 / (({prefix}testlen + 1e-15) / ({prefix}reflen + 1e-9))) ELSE 1.0 END"
    parts = [f"(({prefix}c{k} + 1e-15) / ({prefix}g{k} + 1e-9))" for k in (1, 2, 3, 4)]
    return ", ".join(f"round(power({' * '.join(parts[:k])}, {1.0 / k!r}) * {brevity}, 6) AS bleu{k}" for k in (1, 2, 3, 4))


TOTAL = f"""WITH {_COUNTS},
t AS (SELECT CAST(sum(testlen) AS BIGINT) AS testlen, sum(reflen) AS reflen, {", ".join(f"sum(g{k}) AS g{k}, sum(c{k}) AS c{k}" for k in (1, 2, 3, 4))} FROM counts)
SELECT {_bleu_sql("")}, testlen, round(reflen, 6) AS reflen FROM t"""
_LCS = """
lcs(id, ref, i, line, a, b) AS (
  SELECT id, ref, 0, list_transform(range(len(b) + 1), lambda x: 0), a, b FROM seqs
  UNION ALL
  SELECT id, ref, i + 1,
         list_reduce(list_transform(range(1, len(b) + 1), lambda j: [j]), lambda acc, x: list_append(acc, CASE WHEN b[x[1]] = a[i + 1] THEN line[x[1]] + 1 ELSE greatest(acc[len(acc)], line[x[1] + 1]) END), [0]),
         a, b FROM lcs WHERE i < len(a)),
done AS (SELECT id, ref, line[len(line)] AS lcs, len(a) AS na, len(b) AS nb FROM lcs WHERE i = len(a))"""
_SEQS = f"""{PAIRS},
seqs AS (SELECT id, unnest(range(1, 3)) AS ref, string_split(unnest(refs), ' ') AS a, string_split(hyp, ' ') AS b FROM pairs),"""
_ROUGE = f"""WITH RECURSIVE {_SEQS}{_LCS},
best AS (SELECT id, max(lcs / CAST(nb AS DOUBLE)) AS p, max(lcs / CAST(na AS DOUBLE)) AS q FROM done GROUP BY 1),
rouge AS (SELECT id, CASE WHEN p > 0 AND q > 0 THEN 2.44 * p * q / (q + 1.44 * p) ELSE 0.0 END AS rouge_l FROM best)"""


def _cider_sql(df: str, log_n: str) -> str:
    return f"""{GRAMS}, {df},
hw AS (SELECT g.id, g.k, g.gram, g.n * ({log_n} - ln(greatest(1.0, coalesce(d.df, 0)))) AS w FROM hg g LEFT JOIN df d USING (k, gram)),
rw AS (SELECT g.id, g.ref, g.k, g.gram, g.n * ({log_n} - ln(greatest(1.0, coalesce(d.df, 0)))) AS w FROM rg g LEFT JOIN df d USING (k, gram)),
hn AS (SELECT id, k, sqrt(sum(w * w)) AS n FROM hw GROUP BY 1, 2),
rn AS (SELECT id, ref, k, sqrt(sum(w * w)) AS n FROM rw GROUP BY 1, 2, 3),
dots AS (SELECT a.id, b.ref, a.k, sum(least(a.w, b.w) * b.w) AS dot FROM hw a JOIN rw b USING (id, k, gram) GROUP BY 1, 2, 3),
sims AS (SELECT d.id, CASE WHEN hn.n * rn.n <> 0 THEN d.dot / (hn.n * rn.n) ELSE d.dot END * exp(-power(greatest(0, len(h.t) - 1) - greatest(0, len(r.t) - 1), 2) / 72.0) AS s
  FROM dots d JOIN hn ON hn.id = d.id AND hn.k = d.k JOIN rn ON rn.id = d.id AND rn.ref = d.ref AND rn.k = d.k JOIN h ON h.id = d.id JOIN r ON r.id = d.id AND r.ref = d.ref),
cider AS (SELECT p.id, coalesce((SELECT sum(s) FROM sims x WHERE x.id = p.id), 0.0) / 4 / 2 * 10 AS cider FROM pairs p)"""


_OWN_DF = "df AS (SELECT k, gram, count(DISTINCT id) AS df FROM rg GROUP BY 1, 2)"
_BENCH_DF = f"""bt AS (SELECT item_id, {words_sql("text")} AS t FROM benchmark),
df AS (SELECT k, gram, count(DISTINCT item_id) AS df FROM (SELECT item_id, k, array_to_string(t[i:i+k-1], ' ') AS gram FROM (SELECT item_id, t, k, unnest(range(1, len(t) - k + 2)) AS i FROM bt, ks)) GROUP BY 1, 2)"""
_LOG_N = "(SELECT ln(CAST(count(*) AS DOUBLE)) FROM pairs)"

ORACLE = {
    "txt01_bleu_corpus": TOTAL,
    "txt02_bleu_sentences": f"WITH {_COUNTS} SELECT id, {_bleu_sql('')} FROM counts",
    "txt03_bleu_lengths": f"WITH {_COUNTS} SELECT id, CAST(closest AS DOUBLE) AS closest, CAST(shortest AS DOUBLE) AS shortest, average FROM sizes",
    "agg21_merged_counts": TOTAL,
    "txt04_rouge_l": f"{_ROUGE} SELECT id, round(rouge_l, 6) AS rouge_l FROM rouge",
    "arr04_lcs": f"WITH RECURSIVE {_SEQS}{_LCS} SELECT id, lcs FROM done WHERE ref = 1",
    "txt05_cider": f"WITH {_cider_sql(_OWN_DF, _LOG_N)} SELECT id, round(cider, 6) AS cider FROM cider",
    "txt06_cider_given_frequency": f"WITH {_cider_sql(_BENCH_DF, 'ln(1000.0)')} SELECT id, round(cider, 6) AS cider FROM cider",
    "agg14_document_frequency": f"WITH {GRAMS}, {_OWN_DF} SELECT k AS \"order\", gram, df FROM df",
    "txt08_exact_match": f"""WITH {PAIRS}
SELECT round(avg(CASE WHEN id % 3 = 0 OR list_contains(refs, hyp) THEN 1.0 ELSE 0.0 END) * 100, 6) AS em, count(*) AS n FROM pairs""",
    "txt12_masked_labels": f"""WITH {PAIRS}, f AS (SELECT id, {words_sql("hyp")} AS w FROM pairs)
SELECT id, array_to_string(list_transform(range(1, len(w) + 1), lambda k: CASE WHEN k <= 4 THEN -100 ELSE length(w[k]) END), ',') AS labels FROM f""",
    "agg20_cross_entropy": "SELECT round(sum(CASE WHEN toxic = 1 THEN 0.0 ELSE (doc_id % 10) / 10.0 END), 6) AS loss FROM labels",
    "str_tokens": f"""WITH f AS (SELECT *, {words_sql("text")} AS w FROM conversations)
SELECT conv_id, turn, len(w) AS n_words, len(string_split(text, ' ')) AS n_parts, greatest(0, len(w) - 2) AS n_trigrams,
       md5(CASE WHEN array_to_string({words_sql("replace(text, '|||', ' ')")}, ' ') = '' THEN ' ' ELSE array_to_string({words_sql("replace(text, '|||', ' ')")}, ' ') END) AS line_md5 FROM f""",
    "prj12_first_words": f"""WITH f AS (SELECT doc_id, text, {words_sql("text")} AS w FROM documents),
c AS (SELECT doc_id, CASE WHEN len(w) > 128 THEN array_to_string(w[1:128], ' ') ELSE text END AS t FROM f)
SELECT doc_id, length(t) AS n_chars_cut, md5(t) AS md5 FROM c""",
}


def _bundle_sql() -> str:
    bleu = "(" + TOTAL.replace(", 6) AS bleu", ", 12) AS bleu") + ")"
    rows = [f"SELECT 'bleu{k}' AS metric, bleu{k} AS v FROM b" for k in (1, 2, 3, 4)]
    rows.append(f"SELECT 'rouge_l', (SELECT avg(rouge_l) FROM ({_ROUGE} SELECT rouge_l FROM rouge))")
    rows.append(f"SELECT 'cider', (SELECT avg(cider) FROM (WITH {_cider_sql(_OWN_DF, _LOG_N)} SELECT cider FROM cider))")
    rows.append(f"SELECT 'em', (SELECT avg(CASE WHEN list_contains(refs, hyp) THEN 1.0 ELSE 0.0 END) FROM (WITH {PAIRS} SELECT hyp, refs FROM pairs))")
    return f"WITH b AS {bleu} SELECT metric, round(v * 100, 3) AS value FROM (" + " UNION ALL ".join(rows) + ")"


ORACLE["txt09_bundle"] = _bundle_sql()


def _treebank_sql() -> str:
    out = "q || text || q"
    for pattern, by in arrays.TREEBANK:
        p, b = (x.replace("'", "''") for x in (pattern, by))
        out = f"regexp_replace({out}, '{p}', '{b}', 'g')"
    marks = ", ".join("'" + m.replace("'", "''") + "'" for m in arrays.PUNCTUATION)
    quoted = QUOTED.replace("'", "''")
    return f"""WITH f AS (SELECT conv_id, turn, list_filter(string_split(lower({out}), ' '), lambda w: w <> '') AS w FROM (SELECT *, '{quoted}' AS q FROM conversations))
SELECT conv_id, turn, CAST(len(w) AS INTEGER) AS n, md5(array_to_string(w, ' ')) AS md5, md5(array_to_string(list_filter(w, lambda x: x NOT IN ({marks})), ' ')) AS plain_md5 FROM f"""


ORACLE["str06_treebank"] = _treebank_sql()
_FOUND = r"[\p{L}\p{N}]+|[^\t-\r \p{L}\p{N}]"
ORACLE["txt13_tokens"] = rf"""WITH RECURSIVE vw AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{_FOUND}'))) AS w FROM benchmark),
sw AS (SELECT w FROM vw WHERE length(w) <= 16),
tok AS (SELECT DISTINCT CASE WHEN a > 1 THEN '##' || substr(w, a, n) ELSE substr(w, a, n) END AS token FROM (SELECT w, unnest(range(1, length(w) + 1)) AS a FROM sw), (SELECT unnest([1, 2, 3]) AS n) WHERE a + n - 1 <= length(w)
  UNION SELECT w FROM sw),
voc AS MATERIALIZED (SELECT token, row_number() OVER (ORDER BY token) + {FIRST_ID} AS id FROM tok),
places AS MATERIALIZED (SELECT doc_id, w AS raw, CASE WHEN w IN ('<cand>', '<hist>', '<obj>') THEN w ELSE lower(w) END AS word, pos
  FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all('<hist> ' || coalesce(text, '') || ' <cand><obj>', '<cand>|<hist>|<obj>|{_FOUND}') AS l FROM documents))),
known AS MATERIALIZED (SELECT DISTINCT word FROM places WHERE word NOT IN ('<cand>', '<hist>', '<obj>')),
parts AS (SELECT word, a, n, CASE WHEN a > 1 THEN '##' ELSE '' END || substr(word, a, n) AS token
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS a FROM known WHERE length(word) <= {subwords.LONGEST}), (SELECT unnest(range(1, 17)) AS n) WHERE a + n - 1 <= length(word)),
longest AS MATERIALIZED (SELECT word, a, max(n) AS n, arg_max(id, n) AS id FROM parts JOIN voc USING (token) GROUP BY 1, 2),
walk(word, spot, ids, alive) AS (
  SELECT word, 1::BIGINT, CAST([] AS BIGINT[]), length(word) <= {subwords.LONGEST} FROM known
  UNION ALL
  SELECT w.word, coalesce(w.spot + m.n, w.spot), CASE WHEN m.n IS NULL THEN w.ids ELSE list_append(w.ids, m.id) END, m.n IS NOT NULL
  FROM walk w LEFT JOIN longest m ON m.word = w.word AND m.a = w.spot WHERE w.alive AND w.spot <= length(w.word)),
done AS MATERIALIZED (SELECT word, arg_max(ids, spot) AS ids, max(spot) > length(word) AND bool_and(alive) AS ok FROM walk GROUP BY word),
met AS (SELECT p.doc_id, p.pos, CASE p.word WHEN '<cand>' THEN [4::BIGINT] WHEN '<hist>' THEN [5::BIGINT] WHEN '<obj>' THEN [6::BIGINT] ELSE CASE WHEN d.ok THEN d.ids ELSE [{UNKNOWN}::BIGINT] END END AS ids
  FROM places p LEFT JOIN done d ON d.word = p.word),
seqs AS (SELECT doc_id, list_prepend({BEGIN}, flatten(list(ids ORDER BY pos))) AS ids FROM met GROUP BY 1),
cut AS (SELECT doc_id, ids[greatest(len(ids) - 1023, 1):] AS ids, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM seqs),
wide AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS width FROM cut)
SELECT doc_id, batch, CAST(len(ids) AS INTEGER) AS n, CAST(width AS INTEGER) AS width, md5(array_to_string(list_concat(list_transform(range(width - len(ids)), lambda x: 0), ids), ',')) AS ids_md5,
       md5(array_to_string(list_concat(list_transform(range(width - len(ids)), lambda x: 0), list_transform(ids, lambda x: 1)), ',')) AS mask_md5 FROM wide"""

_METEOR_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+(?:''[\p{{L}}]+)?|[^\s\p{{L}}\p{{N}}]')"
ORACLE["txt07_exact_counts"] = f"""WITH {PAIRS},
ht AS (SELECT id, unnest({_METEOR_TOKENS.format("hyp")}) AS w FROM pairs),
rt AS (SELECT id, ref, unnest({_METEOR_TOKENS.format("t")}) AS w FROM (SELECT id, unnest([1, 2]) AS ref, unnest(refs) AS t FROM pairs)),
often AS (SELECT w FROM rt GROUP BY w HAVING count(*) > {meteor.FREQUENT} * (SELECT count(*) FROM rt)),
hc AS (SELECT id, w, count(*) AS n, w IN (SELECT w FROM often) AS f FROM ht GROUP BY 1, 2),
rc AS (SELECT id, ref, w, count(*) AS n, w IN (SELECT w FROM often) AS f FROM rt GROUP BY 1, 2, 3),
hs AS (SELECT id, sum(CASE WHEN f THEN 0 ELSE n END) AS hyp_content, sum(CASE WHEN f THEN n ELSE 0 END) AS hyp_function FROM hc GROUP BY 1),
rs AS (SELECT id, ref, sum(CASE WHEN f THEN 0 ELSE n END) AS ref_content, sum(CASE WHEN f THEN n ELSE 0 END) AS ref_function FROM rc GROUP BY 1, 2),
m AS (SELECT r.id, r.ref, sum(CASE WHEN r.f THEN 0 ELSE least(h.n, r.n) END) AS c, sum(CASE WHEN r.f THEN least(h.n, r.n) ELSE 0 END) AS fn FROM rc r JOIN hc h ON h.id = r.id AND h.w = r.w GROUP BY 1, 2),
ks AS (SELECT id, CAST(unnest([1, 2]) AS INTEGER) AS ref FROM pairs)
SELECT k.id, k.ref, CAST(coalesce(c, 0) AS BIGINT) AS content, CAST(coalesce(fn, 0) AS BIGINT) AS function, CAST(coalesce(c, 0) AS BIGINT) AS ref_content_matched, CAST(coalesce(fn, 0) AS BIGINT) AS ref_function_matched,
       CAST(coalesce(hyp_content, 0) AS BIGINT) AS hyp_content, CAST(coalesce(hyp_function, 0) AS BIGINT) AS hyp_function, CAST(coalesce(ref_content, 0) AS BIGINT) AS ref_content, CAST(coalesce(ref_function, 0) AS BIGINT) AS ref_function,
       CAST(coalesce(c, 0) + coalesce(fn, 0) AS BIGINT) AS matched
FROM ks k LEFT JOIN hs ON hs.id = k.id LEFT JOIN rs ON rs.id = k.id AND rs.ref = k.ref LEFT JOIN m ON m.id = k.id AND m.ref = k.ref"""
