"""Queries on technical terms: the longer words of the corpus are the terms, and their upper-case forms stand for translations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import corpus as words
from ..operators import dictionary as op
from .registry import query

_W = "list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '')"
_T = f"""WITH terms AS (SELECT word AS term, count(*) AS cnt FROM (SELECT unnest({_W}) AS word FROM documents) WHERE length(word) >= 6 AND regexp_matches(word, '^[a-z]+$') GROUP BY word),
dict AS (SELECT term AS key, CASE WHEN cnt % 3 = 0 THEN '[TRANSLATE:' || term || ']' ELSE upper(term) END AS value, 1 AS ord FROM terms
  UNION ALL SELECT term, upper(term) || '2', 2 FROM terms WHERE length(term) % 5 = 0)"""
# terms within the distinct words of a table: equal first six letters at some place, then the whole term
_IN = """, {0}_words AS (SELECT DISTINCT unnest(string_split(lower(trim(text)), ' ')) AS w FROM {0}), {0}_in AS (
  SELECT DISTINCT w, term FROM (SELECT w, unnest(range(1, greatest(length(w) - 4, 1))) AS i FROM {0}_words) JOIN terms ON substr(term, 1, 6) = substr(w, i, 6) WHERE contains(w, term))"""
_HITS = _T + _IN.format("documents") + ", hits AS (SELECT DISTINCT doc_id, lang, term FROM (SELECT doc_id, lang, unnest(string_split(lower(trim(text)), ' ')) AS w FROM documents) JOIN documents_in USING (w))"


def terms(t):
    """All words of six letters or more."""
    counts = words.word_counts(t("documents"), fn.words(F.col("text"))).withColumnRenamed("word", "term")
    return counts.where((F.length("term") >= 6) & F.col("term").rlike("^[a-z]+$"))


def dictionary(t):
    """Stubs for terms whose count is a multiple of three, a second entry for lengths that are one of five."""
    first = terms(t).select(F.col("term").alias("key"), F.when(F.col("cnt") % 3 == 0, fn.stub(F.col("term"))).otherwise(F.upper("term")).alias("value"), F.lit(1).alias("ord"))
    second = terms(t).where(F.length("term") % 5 == 0).select("term", F.concat(F.upper("term"), F.lit("2")), F.lit(2))
    return first.union(second)


@query(_HITS + " SELECT term, arg_min(lang, doc_id) AS lang, min(doc_id) AS doc_id FROM hits GROUP BY term")
def join_term_first(t):
    return op.term_first(t("documents"), terms(t), "doc_id", "text", "lang")


@query(_HITS + " SELECT doc_id, term FROM hits")
def join_term_all(t):
    return op.matches(t("documents"), terms(t), "doc_id", "text", words=True)


@query(_T + _IN.format("benchmark") + " SELECT term FROM terms WHERE term NOT IN (SELECT term FROM benchmark_in) ORDER BY term")
def join_unmined(t):
    return op.unmined(terms(t), op.matches(t("benchmark"), terms(t), "item_id", "text"))


_USABLE = _T + ", us AS (SELECT key, arg_max(value, ord) AS value FROM dict WHERE NOT starts_with(value, '[NEEDS_') AND NOT starts_with(value, '[TRANSLATE:') GROUP BY key)"


def usable(t):
    return op.usable_entries(dictionary(t), "key", "value", "ord")


@query(_USABLE + " SELECT key, value FROM us")
def filter_dictionary_usable(t):
    return usable(t)


@query(_T + " SELECT key, ord::INT AS ord, starts_with(value, '[TRANSLATE:') AS stub FROM dict")
def is_stub(t):
    return dictionary(t).select("key", "ord", fn.is_stub(F.col("value")).alias("stub"))


@query(_T + " SELECT term, '[TRANSLATE:' || term || ']' AS stub, '[NEEDS_TRANSLATION:' || term || ']' AS needed FROM terms")
def fn_stub(t):
    return terms(t).select("term", fn.stub(F.col("term")).alias("stub"), fn.stub(F.col("term"), True).alias("needed"))


_MINED = _USABLE + _IN.format("benchmark") + """, mined AS (SELECT term, 'item' || min(item_id) AS value FROM (SELECT item_id, unnest(string_split(lower(trim(text)), ' ')) AS w FROM benchmark) JOIN benchmark_in USING (w) GROUP BY term)"""


@query(_MINED + " SELECT terms.term, coalesce(mined.value, us.value, '[TRANSLATE:' || terms.term || ']') AS value FROM terms LEFT JOIN mined USING (term) LEFT JOIN us ON us.key = terms.term")
def join_dictionary_lookup(t):
    """All terms of the documents, mined from the benchmark."""
    items = t("benchmark").withColumn("value", F.concat(F.lit("item"), "item_id"))
    return op.lookup(terms(t), usable(t), op.term_first(items, terms(t), "item_id", "text", "value"))


@query(_USABLE + ", o AS (SELECT DISTINCT key, 'new' AS value FROM us WHERE key > 'm' UNION ALL SELECT 'unknownterm', 'x') SELECT us.key, coalesce(o.value, us.value) AS value FROM us LEFT JOIN o USING (key)")
def join_override(t):
    u = usable(t)
    over = u.where("key > 'm'").select("key", F.lit("new").alias("value"))
    return op.override(u, over.union(over.limit(1).select(F.lit("unknownterm"), F.lit("x"))))


@query(_USABLE + ", s AS (SELECT value AS key, lower(value) || '!' AS value FROM us WHERE key > 'm') SELECT term, us.value AS middle, coalesce(s.value, '?' || us.value) AS value FROM terms JOIN us ON us.key = term LEFT JOIN s ON s.key = us.value")
def join_bridge(t):
    u = usable(t)
    second = u.where("key > 'm'").select(F.col("value").alias("key"), F.concat(F.lower("value"), F.lit("!")).alias("value"))
    return op.bridge(terms(t), u, second, F.concat(F.lit("?"), F.col("middle")))


# a fixed dictionary of letter groups, longest first where they overlap
_PAIRS = [("tionth", "T1"), ("thing", "T2"), ("nter", "T3"), ("ing", "T4"), ("sch", "T5")]
_TAG = "SELECT doc_id, text AS t0, 0 AS n0, '' AS u0 FROM documents"
for _i, (_a, _b) in enumerate(sorted(_PAIRS, key=lambda p: (-len(p[0]), p[0]))):
    _hit = f"position('{_a}' IN lower(t{_i}))"
    _TAG = f"""SELECT doc_id, CASE WHEN {_hit} > 0 THEN substr(t{_i}, 1, {_hit} - 1) || '⟦' || n{_i} || '⟧' || substr(t{_i}, {_hit} + {len(_a)}) ELSE t{_i} END AS t{_i + 1},
 n{_i} + ({_hit} > 0)::INT AS n{_i + 1}, u{_i} || CASE WHEN {_hit} > 0 THEN '{_b} ' ELSE '' END AS u{_i + 1} FROM ({_TAG})"""
_RESTORE = f"SELECT doc_id, t5 AS tagged, trim(u5) AS used FROM ({_TAG})"


def tagged(t):
    return op.tag_terms(t("documents").select("doc_id", "text"), "text", _PAIRS)


@query(f"SELECT doc_id, md5(tagged) AS tagged, used FROM ({_RESTORE})")
def join_tag_terms(t):
    return tagged(t).select("doc_id", F.md5(F.col("tagged").cast("binary")).alias("tagged"), F.array_join(F.transform("used", lambda e: e["target"]), " ").alias("used"))


_BACK = "tagged"
for _i in range(5):
    _BACK = f"replace({_BACK}, '⟦{_i}⟧', coalesce(string_split(used, ' ')[{_i + 1}], '⟦{_i}⟧'))"


@query(f"SELECT doc_id, md5(regexp_replace({_BACK}, '⟦[0-9]+⟧', '', 'g')) AS restored FROM ({_RESTORE})")
def fn_restore_placeholders(t):
    targets = F.transform("used", lambda e: e["target"])
    return tagged(t).select("doc_id", F.md5(fn.restore_placeholders(F.col("tagged"), targets).cast("binary")).alias("restored"))


@query(
    f"""SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN lang = 'fr' THEN 'passthrough' WHEN used <> '' AND n_chars > 1000 THEN 'dictionary+model' WHEN used <> '' THEN 'dictionary' WHEN n_chars > 1000 THEN 'model' ELSE 'none' END AS method
FROM documents JOIN ({_RESTORE}) USING (doc_id)"""
)
def fn_translation_method(t):
    d = op.tag_terms(t("documents"), "text", _PAIRS)
    return d.select("doc_id", fn.translation_method(F.col("text"), F.size("used") > 0, F.col("n_chars") > 1000, F.col("lang") == "fr").alias("method"))


_GRAPHEMES = [("sch", "ʃ"), ("ch", "x"), ("qu", "kv"), ("th", "θ"), ("ng", "ŋ"), ("ei", "aɪ"), ("ou", "u"), ("é", "e"), ("z", "ts"), ("c", "k")]
_OVER = "word"
for _a, _b in sorted(_GRAPHEMES, key=lambda p: (-len(p[0]), p[0])):
    _OVER = f"replace({_OVER}, '{_a}', '{_b}')"
_DW = f"(SELECT DISTINCT unnest({_W}) AS word FROM documents)"


def vocabulary(t):
    return words.word_counts(t("documents"), fn.words(F.col("text"))).select("word")


@query(f"SELECT word, {_OVER} AS ipa FROM {_DW}")
def fn_apply_grapheme_overrides(t):
    return vocabulary(t).select("word", fn.apply_overrides(F.col("word"), _GRAPHEMES).alias("ipa"))


@query(f"SELECT word, trim(replace(replace(word, '%', '*'), '*', '')) AS ipa FROM {_DW}")
def fn_scrub_ipa(t):
    return vocabulary(t).select("word", fn.scrub_ipa(F.replace("word", F.lit("%"), F.lit("*"))).alias("ipa"))


@query(f"SELECT word AS key, word || '!' AS value FROM {_DW} WHERE length(word) <= 4 AND regexp_matches(word, '[À-ÿ]')")
def select_grapheme_overrides(t):
    return op.grapheme_overrides(vocabulary(t).withColumn("v", F.concat(F.lit("/"), "word", F.lit("!/"))), "word", "v", "[À-ÿ]")


# from each place of a word, the longest entry of the table or the letter itself
_G2P = f"""WITH RECURSIVE w AS (SELECT word FROM {_DW}), g AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _GRAPHEMES)}) AS g(key, value)),
walk AS (
  SELECT word, 1 AS i, '' AS ipa FROM w
  UNION ALL SELECT word, i + CASE WHEN g3.key IS NOT NULL THEN 3 WHEN g2.key IS NOT NULL THEN 2 ELSE 1 END, ipa || coalesce(g3.value, g2.value, g1.value, substr(word, i, 1))
  FROM walk LEFT JOIN g g3 ON length(g3.key) = 3 AND g3.key = substr(word, i, 3) LEFT JOIN g g2 ON length(g2.key) = 2 AND g2.key = substr(word, i, 2) LEFT JOIN g g1 ON g1.key = substr(word, i, 1) WHERE i <= length(word))
SELECT word, CASE WHEN length(word) = 2 THEN '<' || word || '>' ELSE ipa END AS ipa FROM walk WHERE i > length(word)"""


@query(_G2P)
def job_g2p_table(t):
    """Greedy longest-match phonetisation of all words; words of two letters are overridden."""
    table = t.spark.createDataFrame(_GRAPHEMES, "key string, value string")
    over = vocabulary(t).where("length(word) = 2").select(F.col("word").alias("key"), F.concat(F.lit("<"), "word", F.lit(">")).alias("value"))
    return op.phonetise(vocabulary(t), table, over)
