"""Queries on corpora, words and n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numbers
from ..functions import text as fn
from ..operators import corpus as op
from ..operators import language_model as lm
from ..operators import whole_model
from ..operators.ordered import running_sums
from ..sources.storage import kept
from .registry import query

_W = "list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '')"
_U = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')"


def doc_words():
    return fn.words(F.col("text"))


@query("SELECT doc_id, trim(text) AS src, trim(lang) AS tgt FROM documents WHERE text <> '' AND lang <> ''")
def normalize_pairs(t):
    return op.normalize_pairs(t("documents"), ["src", "text"], ["tgt", "lang"], keep=("doc_id",))


@query("SELECT doc_id, trim(text) AS text FROM documents WHERE trim(text) <> ''")
def filter_nonblank(t):
    return op.filter_nonblank(t("documents").select("doc_id", "text"), "text")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de')")
def filter_language(t):
    return op.filter_language(t("documents").select("doc_id", "lang"), ["fr", "de"])


@query("SELECT doc_id, md5(text || '|||' || lang) AS pair_key FROM documents")
def fn_pair_key(t):
    return t("documents").select("doc_id", fn.pair_key(F.col("text"), F.col("lang")).alias("pair_key"))


@query("SELECT md5(text || '|||' || lang) AS pair_key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def agg_dedup_pairs(t):
    return op.dedup_pairs(t("documents").select("doc_id", "text", "lang"), "text", "lang", "doc_id").select("pair_key", "doc_id")


@query(f"SELECT doc_id, len({_W}) AS n_words, {_W}[1] AS first_word FROM documents")
def fn_split_words(t):
    return t("documents").select("doc_id", F.size(doc_words()).alias("n_words"), F.get(doc_words(), F.lit(0)).alias("first_word"))


@query(
    "SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([!-/:-@\\[-`{-~])', ' \\1 ', 'g'), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS n_tokens FROM documents"
)
def fn_tokenize_indic(t):
    return t("documents").select("doc_id", F.size(fn.tokens(F.col("text"))).alias("n_tokens"))


_COUNTS = f"""WITH d AS (SELECT {_W} AS t FROM documents), g AS (
  SELECT 1 AS n, [x] AS gram FROM (SELECT unnest(t) AS x FROM d)
  UNION ALL SELECT 2, t[i:i+1] FROM (SELECT t, unnest(range(1, len(t))) AS i FROM d)
  UNION ALL SELECT 3, t[i:i+2] FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM d)),
counts AS (SELECT n, gram, count(*) AS cnt FROM g GROUP BY n, gram)"""


@query(_COUNTS + " SELECT n, array_to_string(gram, ' ') AS gram, cnt FROM counts")
def agg_ngram_counts(t):
    return op.text_ngram_counts(t("documents"), F.col("text"))


@query(f"SELECT word, count(*) AS cnt FROM (SELECT unnest({_W}) AS word FROM documents) GROUP BY word")
def agg_word_freq(t):
    return op.word_counts(t("documents"), doc_words())


@query(f"SELECT word, cnt FROM (SELECT word, count(*) AS cnt FROM (SELECT unnest({_W}) AS word FROM documents) GROUP BY word) ORDER BY cnt DESC, word")
def sort_frequency(t):
    return op.word_counts(t("documents"), doc_words()).orderBy(F.desc("cnt"), "word")


@query(f"SELECT DISTINCT word FROM (SELECT unnest({_U}) AS word FROM documents) ORDER BY word")
def sort_vocab(t):
    return op.distinct_words(t("documents"), "text").orderBy("word")


@query(f"SELECT DISTINCT word FROM (SELECT unnest({_U}) AS word FROM documents)")
def set_distinct_words(t):
    return op.distinct_words(t("documents"), "text")


@query(f"SELECT word, length(word) AS chars FROM (SELECT DISTINCT unnest({_W}) AS word FROM benchmark) ORDER BY chars DESC, word")
def sort_longest_first(t):
    return t("benchmark").select(F.explode(doc_words()).alias("word")).distinct().withColumn("chars", F.length("word")).orderBy(F.desc("chars"), "word")


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 100")
def limit_head(t):
    return t("embeddings").select("vec_id", "label").orderBy("vec_id").limit(100)


@query("SELECT * FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5")
def topk_candidates(t):
    rank = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return t("documents").select("source", "doc_id", "n_chars").withColumn("rank", rank).where("rank <= 5")


@query("SELECT text, doc_id, lang, NULL AS role FROM documents UNION ALL SELECT text, conv_id, NULL, role FROM conversations")
def set_union_corpora(t):
    return op.union_corpora([t("documents").select("text", "doc_id", "lang"), t("conversations").select("text", F.col("conv_id").alias("doc_id"), "role")])


@query(f"SELECT unnest({_U}) AS word FROM documents UNION SELECT lower(unnest({_U})) FROM benchmark")
def set_union_vocab(t):
    return op.union_vocabulary(op.distinct_words(t("documents"), "text"), op.distinct_words(t("benchmark"), "text"))


@query(f"SELECT unnest({_W}) AS word FROM benchmark EXCEPT SELECT unnest({_W}) FROM conversations")
def set_except_terms(t):
    return op.except_terms(*(t(n).select(F.explode(doc_words()).alias("word")) for n in ("benchmark", "conversations")))


@query("SELECT lang, count(*) AS cnt FROM documents GROUP BY lang")
def agg_category_counts(t):
    return op.category_counts(t("documents"), "lang")


@query(
    """SELECT coalesce(source, 'unknown') AS speaker_id, arg_min(lang, doc_id) AS gender, count(*) AS num_utterances,
  round(sum(n_chars), 2)::BIGINT AS total_duration_sec, round(avg(n_chars), 2) AS avg_duration_sec FROM documents GROUP BY 1 ORDER BY 1"""
)
def agg_speaker_stats(t):
    return op.speaker_stats(t("documents"), "source", "n_chars", "lang", "doc_id").withColumn("total_duration_sec", F.col("total_duration_sec").cast("long"))


@query(
    f"""WITH f AS (SELECT lower(word) AS term_key, arg_min(source, doc_id) AS domain FROM (SELECT source, doc_id, unnest({_U}) AS word FROM documents) GROUP BY 1)
SELECT term_key, domain, count(*) OVER (PARTITION BY domain) AS domain_terms FROM f"""
)
def agg_terms_by_domain(t):
    terms = t("documents").select("source", "doc_id", F.explode(fn.words(F.col("text"), lower=False)).alias("word"))
    return op.terms_by_domain(terms, "source", "word", "doc_id")


@query(
    """WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '42'), doc_id) AS k FROM labels),
n AS (SELECT min(c) AS c FROM (SELECT count(*) AS c FROM labels GROUP BY quality))
SELECT doc_id, quality FROM r, n WHERE k <= c"""
)
def agg_balance_classes(t):
    return op.balance_classes(t("labels").select("doc_id", "quality"), "quality", "doc_id")


@query(
    """SELECT doc_id, CASE WHEN own + rest > 0 AND own / (own + rest) > 0.05 THEN 'accented' ELSE 'plain' END AS script FROM (
  SELECT doc_id, len(regexp_extract_all(text, '[À-ÿ]')) AS own, len(regexp_extract_all(text, '[a-zA-Z]')) AS rest FROM documents)"""
)
def fn_script_language(t):
    return t("documents").select("doc_id", fn.script_language(F.col("text"), "[À-ÿ]", "accented", other="plain", share=0.05).alias("script"))


_TERMS = f"terms AS (SELECT DISTINCT unnest({_W}) AS term FROM benchmark), uni AS (SELECT word, count(*) AS cnt FROM (SELECT unnest({_W}) AS word FROM documents) GROUP BY word)"
_FREQ = f"WITH {_TERMS}, f AS (SELECT term, coalesce(cnt, 0) AS cnt, coalesce(cnt, 0) / greatest((SELECT sum(cnt) FROM uni), 1) AS freq FROM terms LEFT JOIN uni ON term = word)"


def term_frequencies(t):
    terms = t("benchmark").select(F.explode(doc_words()).alias("term")).distinct()
    return op.term_frequency(terms, op.word_counts(t("documents"), doc_words()))


@query(_FREQ + " SELECT term, cnt, round(freq, 9) AS freq FROM f")
def join_term_frequency(t):
    return term_frequencies(t).select("term", "cnt", numbers.rounded("freq", 9).alias("freq"))


@query(_FREQ + " SELECT term, CASE WHEN freq < 1e-5 THEN 5.0 WHEN freq < 1e-4 THEN 2.5 ELSE 0.5 END::DOUBLE AS bias FROM f")
def fn_bias_3bin(t):
    return term_frequencies(t).select("term", fn.bias_3bin(F.col("freq")).alias("bias"))


@query(_FREQ + " SELECT term, CASE WHEN freq < 1e-5 THEN 5.0 WHEN freq < 1e-4 THEN 3.0 WHEN freq < 1e-3 THEN 2.0 ELSE 1.0 END::DOUBLE AS bias FROM f")
def fn_bias_4bin(t):
    return term_frequencies(t).select("term", numbers.rounded(fn.bias_4bin(F.col("freq")), 1).alias("bias"))


_O = "list_filter({0}, lambda x: x NOT IN ('<s>', '</s>', '<unk>'))"
_KN = (
    f"""WITH d AS (SELECT list_concat(['<s>'], t, ['</s>']) AS t FROM (SELECT {_O.format(_W)} AS t FROM documents) WHERE len(t) > 0), g AS (
  SELECT 1 AS n, [x] AS gram FROM (SELECT unnest(t) AS x FROM d)
  UNION ALL SELECT 2, t[i:i+1] FROM (SELECT t, unnest(range(1, len(t))) AS i FROM d)
  UNION ALL SELECT 3, t[i:i+2] FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM d)),
counts AS (SELECT n, gram, count(*) AS cnt FROM g GROUP BY n, gram),
a AS (SELECT n, gram, cnt AS c FROM counts WHERE n = 3 OR n = 2 AND gram[1] = '<s>' UNION ALL SELECT n - 1, gram[2:], count(*) FROM counts WHERE n > 1 GROUP BY ALL),
t AS (SELECT n, count(*) FILTER (c = 1) AS t1, count(*) FILTER (c = 2) AS t2, count(*) FILTER (c = 3) AS t3, count(*) FILTER (c = 4) AS t4 FROM a GROUP BY n),
e AS (SELECT n, 1 - 2 * y * t2 / nullif(t1, 0) AS e1, 2 - 3 * y * t3 / nullif(t2, 0) AS e2, 3 - 4 * y * t4 / nullif(t3, 0) AS e3 FROM (SELECT *, t1 / nullif(t1 + 2 * t2, 0) AS y FROM t)),
f AS (SELECT *, coalesce(e1 BETWEEN 0 AND 1 AND e2 BETWEEN 0 AND 2 AND e3 BETWEEN 0 AND 3, FALSE) AS ok FROM e),
r AS (SELECT a.*, CASE WHEN ok THEN CASE c WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END ELSE CASE c WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 1.5 END END::DOUBLE AS d FROM a JOIN f USING (n)),
x AS (SELECT n, gram[1:n-1] AS ctx, sum(c) AS t, sum(d) / sum(c) AS rest, count(*) + 1 AS kinds FROM r GROUP BY n, gram[1:n-1]),
p1 AS (SELECT gram, (c - d) / t + rest / kinds AS p FROM r JOIN x ON r.n = 1 AND x.n = 1),
p2 AS (SELECT r.gram, (c - d) / t + rest * p1.p AS p FROM r JOIN x ON r.n = 2 AND x.n = 2 AND ctx = r.gram[1:1] JOIN p1 ON p1.gram = r.gram[2:2]),
p3 AS (SELECT r.gram, (c - d) / t + rest * p2.p AS p FROM r JOIN x ON r.n = 3 AND x.n = 3 AND ctx = r.gram[1:2] JOIN p2 ON p2.gram = r.gram[2:3]),
p AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT ['<unk>'], rest / kinds FROM x WHERE n = 1 UNION ALL SELECT ['<s>'], 0.0),
model AS (SELECT len(p.gram) AS n, p.gram, p, coalesce(rest, 1) AS backoff FROM p LEFT JOIN x ON x.n > 1 AND x.ctx = p.gram)"""
)
_SCORE = (
    _KN
    + f""", s AS (SELECT item_id, {_O.format(_W)} AS own FROM benchmark), b AS (SELECT item_id, list_concat(['<s>'], own, ['</s>']) AS t FROM s WHERE len(own) > 0),
w AS (SELECT item_id, t, unnest(range(2, len(t) + 1)) AS i FROM b),
q AS (SELECT item_id, coalesce(m3.p, m2.p * coalesce(b2.backoff, 1), coalesce(m1.p, (SELECT p FROM model WHERE gram = ['<unk>'])) * coalesce(b1.backoff, 1) * coalesce(b2.backoff, 1)) AS p FROM w
  LEFT JOIN model m1 ON m1.gram = t[i:i] LEFT JOIN model m2 ON m2.gram = t[i-1:i] LEFT JOIN model m3 ON i > 2 AND m3.gram = t[i-2:i]
  LEFT JOIN model b1 ON b1.gram = t[i-1:i-1] LEFT JOIN model b2 ON i > 2 AND b2.gram = t[i-2:i-1]),
score AS (SELECT s.item_id, len(own) AS n_words, coalesce(sum(log10(p)), 0) AS score FROM s LEFT JOIN q USING (item_id) GROUP BY ALL)"""
)


def benchmark_scores(t):
    """The model is estimated for the grams of the benchmark, from the counts of all documents."""
    wanted = kept(lm.asked_grams(t("benchmark"), doc_words()), "asked")
    return lm.lm_scores(t("benchmark"), kept(lm.kneser_ney(lm.sentence_grams(t("documents"), doc_words()), wanted=wanted), "model"), "item_id", doc_words())


@query(_KN + " SELECT n, array_to_string(gram, ' ') AS gram, round(p, 7) AS p, round(backoff, 7) AS backoff FROM model")
def agg_lm_estimate(t):
    return whole_model.estimate(t("documents"), F.col("text")).select("n", "gram", numbers.rounded("p", 7).alias("p"), numbers.rounded("backoff", 7).alias("backoff"))


@query(_SCORE + " SELECT item_id, n_words, round(score, 5) AS score FROM score")
def join_lm_score(t):
    return benchmark_scores(t).select("item_id", "n_words", numbers.rounded("score", 5).alias("score"))


@query(_SCORE + " SELECT item_id, round(pow(10, -score / greatest(n_words, 1)), 3) AS perplexity FROM score")
def agg_perplexity(t):
    return benchmark_scores(t).select("item_id", numbers.rounded(lm.perplexity(F.col("score"), F.col("n_words")), 3).alias("perplexity"))


@query(
    _SCORE
    + """, cand AS (SELECT item_id // 5 AS utt, item_id, length(text)::DOUBLE / 100 AS base FROM benchmark),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY utt ORDER BY base DESC, item_id) AS k FROM cand) WHERE k <= 3)
SELECT utt, arg_max(item_id, total) AS item_id, round(max(total), 5) AS total FROM (SELECT utt, item_id, base + 0.3 * score + 3.0 * (item_id % 2) AS total FROM top JOIN score USING (item_id)) GROUP BY utt"""
)
def job_nbest_rescore(t):
    """The three best candidates of each utterance, scored anew with the language model and a bias."""
    cand = t("benchmark").select(F.floor(F.col("item_id") / 5).alias("utt"), "item_id", (F.length("text") / 100.0).alias("base"))
    top = cand.withColumn("k", F.row_number().over(W.partitionBy("utt").orderBy(F.desc("base"), "item_id"))).where("k <= 3")
    scored = top.join(benchmark_scores(t), "item_id").withColumn("total", fn.combine_scores(F.col("base"), F.col("score"), (F.col("item_id") % 2).cast("double")))
    return scored.groupBy("utt").agg(F.max_by("item_id", "total").alias("item_id"), numbers.rounded(F.max("total"), 5).alias("total"))


@query(
    """WITH r AS (SELECT doc_id, rank() OVER (ORDER BY n_chars) AS k FROM documents)
SELECT doc_id, k::DOUBLE + 0.3::DOUBLE * 2 + 3.0::DOUBLE * (doc_id % 2) AS score FROM r"""
)
def fn_combine_scores(t):
    # ranks from counts per distinct value
    sizes = t("documents").groupBy("n_chars").agg(F.count("*").alias("c"))
    ranks = running_sums(sizes, "n_chars", ["c"]).select("n_chars", (F.col("c_before") + 1).alias("k"))
    return t("documents").join(ranks, "n_chars").select("doc_id", fn.combine_scores(F.col("k").cast("double"), F.lit(2.0), (F.col("doc_id") % 2).cast("double")).alias("score"))


@query("SELECT page_id, regexp_extract(url, '([^/]*?)(\\.[^./]*)?$', 1) AS stem, regexp_extract(url, '[^/](\\.[^./]*)$', 1) AS suffix FROM pages")
def fn_path_parts(t):
    return t("pages").select("page_id", fn.stem(F.col("url")).alias("stem"), fn.suffix(F.col("url")).alias("suffix"))


@query(
    """SELECT doc_id, CASE WHEN l IN ('en', 'eng', 'english') THEN 'en' WHEN l IN ('hi', 'hin', 'hindi') THEN 'hi' WHEN l IN ('mai', 'maithili') THEN 'mai' ELSE 'other' END AS route
FROM (SELECT doc_id, lower(trim(lang)) AS l FROM documents)"""
)
def route_language(t):
    return t("documents").select("doc_id", fn.route_language(F.col("lang")).alias("route"))


@query("SELECT doc_id, coalesce(NULL, lang, source) AS tag FROM documents")
def fn_pick_key(t):
    return t("documents").select("doc_id", fn.pick_key(F.lit(None).cast("string"), F.col("lang"), F.col("source")).alias("tag"))


@query(
    _FREQ
    + """ SELECT term, cnt, CASE WHEN freq < 1e-5 THEN 5.0 WHEN freq < 1e-4 THEN 3.0 WHEN freq < 1e-3 THEN 2.0 ELSE 1.0 END::DOUBLE AS bias,
  cnt = 0 AS unseen FROM f"""
)
def job_ngram_prep(t):
    """Clean text, count words, and take the terms' bias table from them."""
    uni = op.word_counts(op.filter_nonblank(t("documents").select("text"), "text"), doc_words())
    terms = t("benchmark").select(F.explode(doc_words()).alias("term")).distinct()
    f = op.term_frequency(terms, uni)
    return f.select("term", "cnt", fn.bias_4bin(F.col("freq")).alias("bias"), (F.col("cnt") == 0).alias("unseen"))


@query(
    """WITH p AS (SELECT trim(text) AS src, trim(lang) AS tgt, doc_id FROM documents WHERE text <> '' AND lang <> ''),
d AS (SELECT md5(src || '|||' || tgt) AS pair_key, min(doc_id) AS doc_id FROM p GROUP BY 1)
SELECT doc_id, pair_key, tgt, CASE WHEN ('0x' || substr(md5(pair_key || '42'), 1, 4))::INT % 10 < 8 THEN 'train' WHEN ('0x' || substr(md5(pair_key || '42'), 1, 4))::INT % 10 = 8 THEN 'valid' ELSE 'test' END AS split
FROM d JOIN p USING (doc_id)"""
)
def job_parallel_prep(t):
    """Normalise, drop repeated pairs, and split by the pair's hash."""
    pairs = op.normalize_pairs(t("documents"), ["text"], ["lang"], keep=("doc_id",))
    k = F.conv(F.substring(F.md5(F.concat("pair_key", F.lit("42")).cast("binary")), 1, 4), 16, 10).cast("int") % 10
    return op.dedup_pairs(pairs, "src", "tgt", "doc_id").select("doc_id", "pair_key", "tgt", F.when(k < 8, "train").when(k == 8, "valid").otherwise("test").alias("split"))
