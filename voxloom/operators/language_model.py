"""Language models of words: Kneser-Ney estimates with discounts from counts of counts, sentence boundaries, and scores.

A sentence is counted and scored between the marks ``<s>`` and ``</s>``; words that look like a mark are left out of both, and
so are sentences without words. ``<s>`` is never predicted; ``</s>`` and the unknown word ``<unk>`` are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fn
from ..sources.storage import kept
from .corpus import gram_size

BEGIN, END, UNKNOWN = "<s>", "</s>", "<unk>"
ORDER = 3
#: Words of the shortest sentence with its marks.
LEAST = 3


def bounded(tokens: Column) -> Column:
    """The tokens of a sentence between its marks; null without tokens."""
    own = F.filter(tokens, lambda w: ~w.isin(BEGIN, END, UNKNOWN))
    return F.when(F.size(own) > 0, F.concat(F.array(F.lit(BEGIN)), own, F.array(F.lit(END))))


def sentence_grams(df: DataFrame, tokens: Column, order: int = ORDER) -> DataFrame:
    """(n, gram, cnt) of the grams of ``order`` words of the sentences with their marks; a sentence of fewer is one gram. All shorter
    grams are heads and tails of these, see ``lower_counts``."""
    rows = df.select(bounded(tokens).alias("_s")).where("_s IS NOT NULL")
    grams = F.when(F.size("_s") < order, F.array(F.array_join("_s", " "))).otherwise(fn.ngrams(F.col("_s"), order))
    counts = rows.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("cnt"))
    return counts.select(gram_size(F.col("gram")).alias("n"), "gram", "cnt")


def _head(gram: Column, n: int) -> Column:
    return F.substring_index(gram, " ", n)


def _tail(gram: Column) -> Column:
    return F.substring(gram, F.locate(" ", gram) + 1, F.length(gram))


def lower_counts(upper: DataFrame, n: int, short: DataFrame | None = None) -> DataFrame:
    """(gram, c) of n words from ``upper`` (gram, c), which are all of one word more: the number of different words before a gram, or
    occurrences of one that begins a sentence, of which no word can stand before. ``short`` are sentences of n words. The mark
    of the beginning is no gram by itself. One shuffle."""
    parts = F.array(F.struct(_tail(F.col("gram")).alias("gram"), F.lit(1).cast("long").alias("c")))
    if n > 1:
        begin = F.array(F.struct(_head(F.col("gram"), n).alias("gram"), F.col("c")))
        parts = F.when(F.startswith("gram", F.lit(BEGIN + " ")), F.concat(parts, begin)).otherwise(parts)
    rows = upper.select(F.explode(parts).alias("g")).select("g.gram", "g.c")
    return (rows if short is None else rows.union(short)).groupBy("gram").agg(F.sum("c").alias("c"))


def adjusted_counts(counts: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """(gram, c) for 1 to ``order`` words, from ``sentence_grams``: occurrences for the highest order, else as ``lower_counts`` says. Each
    is stored, as discounts and estimates read it and the next is made from it."""
    counts = kept(counts, "counts") if order > LEAST else counts
    levels = [kept(counts.where(F.col("n") == order).select("gram", F.col("cnt").alias("c")), "adjusted")]
    for n in range(order - 1, 0, -1):
        # only sentences of at least one word are counted, so that there are none of fewer than three words with the marks
        short = counts.where(F.col("n") == n).select("gram", F.col("cnt").alias("c")) if n >= LEAST else None
        levels.insert(0, kept(lower_counts(levels[0], n, short), "adjusted"))
    return levels


def discounts(adjusted: DataFrame) -> DataFrame:
    """(n, d1, d2, d3): what is taken from counts of one, two, and three or more, estimated for each order from how many
    grams have counts of one to four. An order in which these are missing or give no discount between 0 and the count
    takes 0.5, 1 and 1.5."""
    t = adjusted.groupBy("n").agg(*(F.sum((F.col("c") == k).cast("double")).alias(f"t{k}") for k in (1, 2, 3, 4)))
    y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))
    found = [k - (k + 1) * y * F.try_divide(F.col(f"t{k + 1}"), F.col(f"t{k}")) for k in (1, 2, 3)]
    right = F.lit(True)
    for k, d in enumerate(found, 1):
        right = right & F.coalesce((d >= 0) & (d <= k), F.lit(False))
    # fixed values: the usual discounts of an order too small for estimates
    return t.select("n", *(F.when(right, d).otherwise(F.lit(usual)).alias(f"d{k}") for k, (d, usual) in enumerate(zip(found, (0.5, 1.0, 1.5)), 1)))


def kneser_ney(counts: DataFrame, order: int = ORDER, wanted: DataFrame | None = None) -> DataFrame:
    """(n, gram, p, backoff) from ``sentence_grams``: interpolated, with three discounts for each order. ``p`` is the probability
    of the last word after the others; a word that was not seen after them has ``backoff`` of these times its probability
    after one word less. Unigrams share what discounts leave evenly with the unknown word, so that the
    probabilities after any words sum to one. The mark of the beginning has probability 0 and a weight.

    With ``wanted`` (gram), only these grams, of any number of words, and those that their estimates are made of are estimated, from
    the counts of all; the rows are those of the whole model."""
    levels = adjusted_counts(counts, order)
    all_ = levels[0].withColumn("n", F.lit(1))
    for n, level in enumerate(levels[1:], 2):
        all_ = all_.union(level.withColumn("n", F.lit(n)))
    found = kept(discounts(all_), "discounts")  # a row for each order, read for each
    # a count of k is discounted by d1, d2, or d3 for all larger ones
    amount = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = lambda n: levels[n - 1].join(F.broadcast(found.where(F.col("n") == n))).select("gram", "c", amount.alias("d"))
    share = lambda: (F.sum("c").alias("t"), (F.sum("d") / F.sum("c")).alias("left"))
    total = F.broadcast(rows(1).agg(*share(), (F.count("*") + 1).alias("kinds")).where("t IS NOT NULL"))
    even = F.col("left") / F.col("kinds")
    p = rows(1).join(total).select("gram", ((F.col("c") - F.col("d")) / F.col("t") + even).alias("p"))
    p = p.union(total.select(F.lit(UNKNOWN), even)).union(total.select(F.lit(BEGIN), F.lit(0.0)))
    need = None
    if wanted is not None:
        need = [wanted.select("gram").where(gram_size(F.col("gram")) == n) for n in range(1, order + 1)]
        for n in range(order - 1, 0, -1):  # the tail of a gram that is wanted is part of its estimate
            need[n - 1] = need[n - 1].union(need[n].select(_tail(F.col("gram")))).distinct()
    model = None
    for n in range(1, order + 1):
        if n > 1:
            own = rows(n).select(_head(F.col("gram"), n - 1).alias("ctx"), F.substring_index("gram", " ", -1).alias("last"), "c", "d")
            if need:
                asked = need[n - 1].select(_head(F.col("gram"), n - 1).alias("ctx"), F.substring_index("gram", " ", -1).alias("last"))
                own = own.join(asked, ["ctx", "last"], "left_semi")
            low = F.concat_ws(" ", *([_tail(F.col("ctx"))] if n > 2 else []), F.col("last"))
            # the gram is its first word and the rest: neither is shuffled twice
            own = own.join(weight, "ctx").select(_head(F.col("ctx"), 1).alias("first"), low.alias("gram"), ((F.col("c") - F.col("d")) / F.col("t")).alias("x"), "left")
            p = own.join(model.select("gram", "p"), "gram").select(F.concat_ws(" ", "first", "gram").alias("gram"), (F.col("x") + F.col("left") * F.col("p")).alias("p"))
        if need and n == 1:
            p = p.join(need[0].union(total.select(F.lit(UNKNOWN))).distinct(), "gram", "left_semi")
        if n < order:
            longer = rows(n + 1).select(_head(F.col("gram"), n).alias("ctx"), "c", "d")
            if need:  # weights of what is wanted, and of the contexts of the longer grams that are
                asked = need[n - 1].select(F.col("gram").alias("ctx")).union(need[n].select(_head(F.col("gram"), n))).distinct()
                longer = longer.join(asked, "ctx", "left_semi")
            weight = longer.groupBy("ctx").agg(*share())
            weight = kept(weight, "weights") if need else weight
            p = p.join(weight.select(F.col("ctx").alias("gram"), F.col("left").alias("backoff")), "gram", "left").select("gram", "p", F.coalesce("backoff", F.lit(1.0)).alias("backoff"))
            p = kept(p, "model")  # read as a part of the model and for the next order
        else:
            p = p.withColumn("backoff", F.lit(1.0))  # no context is as long
        p = p.select(F.lit(n).alias("n"), "gram", "p", "backoff")
        model, parts = p, [p] if n == 1 else [*parts, p]
    return reduce(lambda a, b: a.union(b), parts)


def asked_grams(sentences: DataFrame, tokens: Column) -> DataFrame:
    """(gram): what ``lm_scores`` looks up in the model, distinct."""
    s = sentences.select(bounded(tokens).alias("s")).where("s IS NOT NULL")
    return s.select(F.explode(F.concat(*(fn.ngrams(F.col("s"), n) for n in range(1, ORDER + 1)))).alias("gram")).distinct()


def lm_scores(sentences: DataFrame, model: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, n_words, score): log10 probability of each sentence with its end. A word takes its longest known gram,
    times the weights of the contexts that were left. Grams meet the model in one join, whatever the order of the model;
    sentences without words score 0. Keys are distinct. ``model`` is a table of order 3."""
    s = sentences.select(key, F.size(F.filter(tokens, lambda w: ~w.isin(BEGIN, END, UNKNOWN))).cast("long").alias("n_words"), bounded(tokens).alias("s"))
    places = s.select(key, F.posexplode("s").alias("i", "w"), "s")
    gram = lambda n: F.when(F.col("i") >= n - 1, F.struct(F.lit(n).alias("n"), F.array_join(F.slice("s", F.col("i") - (n - 2), F.lit(n)), " ").alias("gram")))
    grams = places.select(key, "i", F.explode(F.array_compact(F.array(*(gram(n) for n in range(1, ORDER + 1))))).alias("g")).select(key, "i", "g.*")
    found = grams.join(model.select("gram", "p", "backoff"), "gram", "left").repartition(key)
    of = lambda c, n: F.max(F.when(F.col("n") == n, F.col(c)))
    rows = found.groupBy(key, "i").agg(*(of("p", n).alias(f"p{n}") for n in (1, 2, 3)), *(F.coalesce(of("backoff", n), F.lit(1.0)).alias(f"b{n}") for n in (1, 2)))
    before = W.partitionBy(key).orderBy("i")
    rows = rows.withColumn("k1", F.lag("b1", 1, 1.0).over(before)).withColumn("k2", F.lag("b2", 1, 1.0).over(before)).where("i > 0")
    unknown = F.broadcast(model.where(F.col("gram") == UNKNOWN).agg(F.max("p").alias("unknown")))  # one row
    p = F.coalesce(F.col("p3"), F.col("p2") * F.col("k2"), F.coalesce("p1", "unknown") * F.col("k1") * F.col("k2"))
    score = rows.join(unknown).groupBy(key).agg(F.sum(F.log10(p)).alias("score"))
    return s.select(key, "n_words").join(score, key, "left").select(key, F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"), F.coalesce("score", F.lit(0.0)).alias("score"))


def perplexity(score: Column, n_words: Column) -> Column:
    """Of a sentence, from its score with the end and its words without."""
    return F.pow(F.lit(10.0), -score / F.greatest(n_words, F.lit(1)))
