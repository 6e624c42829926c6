"""Technical terms: mining translations, tagging texts, dictionary lookups and overrides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.storage import kept

#: Phrases are found by so many letters on each side of their first space.
SIDE = 6


def _clean(terms: DataFrame) -> DataFrame:
    return terms.select(F.lower("term").alias("term")).where("term <> ''").distinct()


def _in_words(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds ``term`` to rows of distinct words: every term without a space that is a substring of ``word``. Every piece of a word that is
    as long as some term is looked up, so each joined row is a pair (twice, if the word has the term twice)."""
    lengths = terms.agg(F.collect_set(F.length("term"))).scalar()
    pieces = rows.where("word <> ''").withColumn("_n", F.explode(lengths)).where(F.col("_n") <= F.length("word"))
    pieces = pieces.withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("_n") + 1)))
    return pieces.withColumn("term", F.substring("word", F.col("_i"), F.col("_n"))).drop("_n", "_i").join(terms, "term")


def _phrases(body: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, term) for terms of several words: joined on the letters around the term's first space, at most ``SIDE`` on each
    side, which the text has at one of its spaces, then verified. Only numbers of letters that some term has are
    looked up, none without such terms."""
    first, rest = F.substring_index("term", " ", 1), F.split("term", " ")[1]
    left, right = F.least(F.length(first), F.lit(SIDE)), F.least(F.length(rest), F.lit(SIDE))
    around = lambda a, b, i, j: F.concat(F.right(a, i), F.lit(" "), F.left(b, j))
    heads = terms.select("term", around(first, rest, left, right).alias("_g"))
    shapes = terms.agg(F.collect_set(F.struct(left.alias("i"), right.alias("j")))).scalar()
    w = F.split("_t", " ")
    sides = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda k: F.struct(F.get(w, k - 1).alias("a"), F.get(w, k).alias("b")))
    # distinct neighbours of all texts are cut, not each text's
    near = body.select("key", F.explode(F.array_distinct(F.when(F.size(w) > 1, sides))).alias("s")).withColumn("_z", shapes).where(F.size("_z") > 0)
    fits = lambda s: F.filter("_z", lambda z: (z["i"] <= F.length(s["a"])) & (z["j"] <= F.length(s["b"])))
    cut = near.select("s", "_z").distinct().select("s", F.explode(F.array_distinct(F.transform(fits(F.col("s")), lambda z: around(F.col("s.a"), F.col("s.b"), z["i"], z["j"])))).alias("_g"))
    pairs = cut.join(heads, "_g").select("s", "term").distinct()
    found = near.join(pairs, "s").select("key", "term").distinct()
    return found.join(body, "key").where(F.contains("_t", "term")).select("key", "term")


def _all_words(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, term) for terms of several words all of which the text has, anywhere."""
    own = terms.select("term", F.array_distinct(fn.words(F.col("term"))).alias("w")).select("term", F.size("w").alias("_n"), F.explode("w").alias("word"))
    return words.join(own, "word").groupBy("key", "term", "_n").agg(F.count("*").alias("_c")).where("_c = _n").select("key", "term")


def _found(corpus: DataFrame, terms: DataFrame, key: str, text: str, words: bool, word_boundary: bool) -> tuple[DataFrame, Callable[[DataFrame], DataFrame], DataFrame]:
    """Words of each text (key, word), how rows of words get the terms in them, and phrases of each text (key, term). Terms are stored
    first: they are read several times, and joins with them are planned by their true size."""
    body = corpus.select(F.col(key).alias("key"), F.lower(F.trim(text)).alias("_t"))
    terms = _clean(terms)
    spaced = lambda c: F.array_join(fn.words(F.col(c)), " ")
    if word_boundary:
        body, terms = body.withColumn("_t", spaced("_t")), terms.select(spaced("term").alias("term")).where("term <> ''").distinct()
    terms = kept(terms, "terms")
    several, single = terms.where(F.contains("term", F.lit(" "))), terms.where(~F.contains("term", F.lit(" ")))
    shortest = single.agg(F.min(F.length("term"))).scalar()  # shorter words have no term and needn't travel
    tokens = body.select("key", F.explode(F.array_distinct(F.split("_t", " "))).alias("word")).where(F.length("word") >= shortest)
    if word_boundary:
        named = lambda rows: rows.join(single.withColumn("word", F.col("term")), "word")
    else:
        named = lambda rows: _in_words(rows, single)
    if several.isEmpty():  # then no text has to meet a phrase
        return tokens, named, body.select("key", F.col("_t").alias("term")).where(F.lit(False))
    if word_boundary:
        whole = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
        phrases = _phrases(body.withColumn("_t", whole("_t")), several.withColumn("term", F.concat("term", F.lit(" ")))).withColumn("term", F.rtrim("term"))
        phrases = phrases.join(body, "key").where(F.contains(whole("_t"), whole("term"))).drop("_t")
    else:
        phrases = _phrases(body, several)
    if words:
        own = body.select("key", F.explode(F.array_distinct(fn.words(F.col("_t")))).alias("word"))
        phrases = phrases.union(_all_words(own, several))
    return tokens, named, phrases


def matches(corpus: DataFrame, terms: DataFrame, key: str, text: str, words: bool = False, word_boundary: bool = False) -> DataFrame:
    """(key, term) for each term that is a substring of the lower-cased trimmed text; with ``words`` also for terms all of
    whose words the text has; with ``word_boundary`` a term has to be whole words of the text. Terms of one word are looked
    for in the distinct words of the corpus, so that the work on them grows with the vocabulary; all joins
    are on equal keys, however many terms there are. Keys are distinct."""
    tokens, named, phrases = _found(corpus, terms, key, text, words, word_boundary)
    pairs = named(tokens.select("word").distinct()).select("word", "term")
    return tokens.join(pairs, "word").select("key", "term").union(phrases.select("key", "term")).distinct().withColumnRenamed("key", key)


def term_first(corpus: DataFrame, terms: DataFrame, key: str, text: str, value: str, words: bool = False, word_boundary: bool = False) -> DataFrame:
    """(term, value, key) from the first row, by key, that has the term: the first row of each word is known before the
    words meet the terms, and only keys are compared. Keys are distinct."""
    tokens, named, phrases = _found(corpus, terms, key, text, words, word_boundary)
    first = tokens.groupBy("word").agg(F.min("key").alias("key"))
    hits = named(first).select("term", "key").union(phrases.select("term", "key"))
    found = hits.groupBy("term").agg(F.min("key").alias(key))
    return found.join(corpus.select(key, value), key).select("term", value, key)


def unmined(terms: DataFrame, found: DataFrame) -> DataFrame:
    return terms.select("term").distinct().join(found.select("term").distinct(), "term", "left_anti").orderBy("term")


def usable_entries(dictionary: DataFrame, key: str, value: str, order: str, strict_reference: bool = False) -> DataFrame:
    """(key, value): keys lower-cased and trimmed, stubs and empty entries dropped, the last of equal keys. With
    ``strict_reference`` stubs for translation stay, as entries of their own."""
    d = dictionary.select(F.lower(F.trim(key)).alias("key"), F.trim(value).alias("value"), F.col(order).alias("at")).where((F.col("key") != "") & fn.usable(F.col("value"), strict_reference))
    return d.groupBy("key").agg(F.max_by("value", "at").alias("value"))


def lookup(terms: DataFrame, dictionary: DataFrame, mined: DataFrame) -> DataFrame:
    """(term, value): mined before the exact key before the lower-cased key before a stub."""
    d = dictionary.select(F.col("key"), F.col("value"))
    exact = terms.select("term").join(d.withColumnRenamed("key", "term").withColumnRenamed("value", "exact"), "term", "left")
    low = exact.withColumn("_low", F.lower("term")).join(d.withColumnRenamed("key", "_low").withColumnRenamed("value", "lower"), "_low", "left")
    m = low.join(mined.select("term", F.col("value").alias("mined")), "term", "left")
    return m.select("term", F.coalesce("mined", "exact", "lower", fn.stub(F.col("term"))).alias("value"))


def override(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """(key, value): overridden where the key is known already."""
    return base.join(overrides.withColumnRenamed("value", "_new"), "key", "left").select("key", F.coalesce("_new", "value").alias("value"))


def bridge(terms: DataFrame, first: DataFrame, second: DataFrame, fallback: Column) -> DataFrame:
    """(term, middle, value): term to middle by ``first`` (dropped if absent), middle to value by ``second``, else ``fallback``."""
    a = terms.select("term").join(first.select(F.col("key").alias("term"), F.col("value").alias("middle")), "term")
    b = a.join(second.select(F.col("key").alias("middle"), "value"), "middle", "left")
    return b.select("term", "middle", F.coalesce("value", fallback).alias("value"))


def tag_terms(df: DataFrame, text: str, terms: list[tuple[str, str]]) -> DataFrame:
    """Adds ``tagged`` and ``used``: the longest terms first, each replaced once, whatever its case, by a mark ``⟦n⟧``
    that no later term can match; ``used`` lists (term, target) in the order of the marks. ``terms`` is a dictionary
    that fits in a query."""
    pairs = sorted(terms, key=lambda p: (-len(p[0]), p[0]))
    entries = F.array(*(F.struct(F.lit(a).alias("term"), F.lit(b).alias("target")) for a, b in pairs))
    none = F.array().cast("array<struct<term:string,target:string>>")

    state = F.struct(F.coalesce(F.col(text), F.lit("")).alias("text"), none.alias("used"))

    def fold(acc, e):
        at = F.instr(F.lower(acc["text"]), F.lower(e["term"]))
        mark = F.concat(F.lit("⟦"), F.size(acc["used"]).cast("string"), F.lit("⟧"))
        text_ = F.concat(F.substring(acc["text"], F.lit(1), at - 1), mark, F.substring(acc["text"], at + F.length(e["term"]), F.length(acc["text"])))
        return F.when(at > 0, F.struct(text_.alias("text"), F.concat(acc["used"], F.array(e)).alias("used"))).otherwise(acc)

    out = F.aggregate(entries, state, fold)
    return df.withColumn("_x", out).withColumn("tagged", F.col("_x.text")).withColumn("used", F.col("_x.used")).drop("_x")


def grapheme_overrides(df: DataFrame, key: str, value: str, script: str = "[ऀ-ॿ]", most: int = 4) -> DataFrame:
    """(key, value): keys of at most ``most`` characters of the script, slashes around values stripped."""
    return df.where((F.length(key) <= most) & F.col(key).rlike(script)).select(F.col(key).alias("key"), F.regexp_replace(F.col(value), r"^/+|/+$", "").alias("value"))


def phonetise(words: DataFrame, table: DataFrame, overrides: DataFrame, longest: int = 3) -> DataFrame:
    """(word, ipa) by greedy longest match of a grapheme table; unknown letters stay; whole-word ``overrides`` win. Of equal
    keys of the table the largest value counts. Distinct words only are phonetised, each with the entries of the table that its
    own pieces have, so that the table may have any size."""
    w = words.select("word").where("word IS NOT NULL").distinct()
    entries = table.where("key IS NOT NULL AND value IS NOT NULL").groupBy("key").agg(F.max("value").alias("value"))
    pieces = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1))), lambda i: F.array(*(F.substring("word", i, F.lit(n)) for n in range(1, longest + 1))))))
    own = w.select("word", F.explode(pieces).alias("key")).join(entries, "key").groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    w = w.join(own, "word", "left").withColumn("m", F.coalesce("m", F.create_map().cast("map<string,string>")))
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("ipa"))

    def fold(acc, _):
        rest = lambda n: F.when(acc["at"] + (n - 1) <= F.length("word"), F.substring("word", acc["at"], F.lit(n)))
        found = F.lit(None).cast("struct<at:int,ipa:string>")
        for n in range(longest, 0, -1):
            v = F.try_element_at(F.col("m"), rest(n))
            found = F.coalesce(found, F.when(v.isNotNull(), F.struct((acc["at"] + n).alias("at"), F.concat(acc["ipa"], v).alias("ipa"))))
        plain = F.struct((acc["at"] + 1).alias("at"), F.concat(acc["ipa"], F.coalesce(rest(1), F.lit(""))).alias("ipa"))
        return F.when(acc["at"] <= F.length("word"), F.coalesce(found, plain)).otherwise(acc)

    ipa = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length("word"), F.lit(1))), start, fold)["ipa"]
    spelt = w.select(F.col("word").alias("key"), ipa.alias("value"))
    return override(spelt, overrides.groupBy("key").agg(F.max("value").alias("value"))).select(F.col("key").alias("word"), F.col("value").alias("ipa"))
