"""The language model against hand-worked values and a plain estimate."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from voxloom.functions import text as fn
from voxloom.operators import language_model as lm


def sentences(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k int, text string")


def model_of(spark, texts):
    return lm.kneser_ney(lm.sentence_grams(sentences(spark, texts), fn.words(F.col("text"))))


def plain(texts):
    """Discounts, probabilities and weights from lists of words."""
    rows = [["<s>", *t.split(), "</s>"] for t in texts if t and t.split()]
    raw = [Counter(tuple(r[i : i + n]) for r in rows for i in range(len(r) - n + 1)) for n in (1, 2, 3)]
    c = {3: raw[2], 2: Counter(g[1:] for g in raw[2]), 1: Counter(g[1:] for g in raw[1])}
    c[2].update({g: k for g, k in raw[1].items() if g[0] == "<s>"})
    d = {}
    for n in c:
        t = [0, *(sum(v == k for v in c[n].values()) for k in (1, 2, 3, 4))]
        d[n] = (0.5, 1.0, 1.5)
        if t[1] and t[2] and t[3]:
            y = t[1] / (t[1] + 2 * t[2])
            e = tuple(k - (k + 1) * y * t[k + 1] / t[k] for k in (1, 2, 3))
            d[n] = e if all(0 <= x <= k for k, x in enumerate(e, 1)) else d[n]
    cut = lambda n, k: d[n][min(k, 3) - 1]
    total, left = defaultdict(int), defaultdict(float)
    for n in c:
        for g, k in c[n].items():
            total[n, g[:-1]] += k
            left[n, g[:-1]] += cut(n, k)
    p = {("<unk>",): left[1, ()] / total[1, ()] / (len(c[1]) + 1), ("<s>",): 0.0}
    for n in (1, 2, 3):
        for g, k in c[n].items():
            lower = p[g[1:]] if n > 1 else 1 / (len(c[1]) + 1)
            p[g] = (k - cut(n, k)) / total[n, g[:-1]] + left[n, g[:-1]] / total[n, g[:-1]] * lower
    return p, {g: left[n, g] / total[n, g] for n, g in total if n > 1}


def probability(p, b, context, word):
    g = (*context, word)
    if g in p:
        return p[g]
    return b.get(tuple(context), 1.0) * probability(p, b, context[1:], word) if context else p["<unk>",]


TEXTS = ["a b c a b d", "a b", "b c a", "d d d a b c", "e", "", None, "a b c a b d a b c", "c e a", "f g f g h", "a b d e", "h a"]


def test_by_hand(spark):
    got = {r.gram: (r.p, r.backoff) for r in model_of(spark, ["a b", "a b", "a c"]).collect()}
    for gram, p in {"a": 0.2, "b": 0.2, "c": 0.2, "</s>": 0.3, "<unk>": 0.1, "<s>": 0.0, "a b": 0.35, "a c": 0.35}.items():
        assert got[gram][0] == pytest.approx(p), gram
    assert got["a"][1] == pytest.approx(0.5) and got["b"][1] == pytest.approx(0.5) and got["<s>"][1] == pytest.approx(1.5 / 3)


def test_against_a_plain_estimate_and_sums_to_one(spark):
    p, b = plain(TEXTS)
    rows = model_of(spark, TEXTS).collect()
    got = {tuple(r.gram.split(" ")): r.p for r in rows}
    weight = {tuple(r.gram.split(" ")): r.backoff for r in rows}
    assert set(got) == set(p) and all(got[g] == pytest.approx(p[g]) for g in p)
    assert all(weight[g] == pytest.approx(w) for g, w in b.items()) and all(r.n == len(r.gram.split(" ")) for r in rows)
    words = [g[0] for g in got if len(g) == 1 and g != ("<s>",)]
    for context in [(), *weight]:
        if len(context) < 3 and context != ("<unk>",) and "</s>" not in context:
            assert sum(probability(got, weight, context, w) for w in words) == pytest.approx(1), context


def test_scores_with_both_boundaries(spark):
    p, b = plain(TEXTS)
    asked = ["a b c", "", None, "zzz a zzz", "h", "a b <s> c", "d d d d d"]
    want = {}
    for k, t in enumerate(asked):
        w = [x for x in (t or "").split() if x != "<s>"]
        line = ["<s>", *w, "</s>"]
        want[k] = (len(w), sum(math.log10(probability(p, b, tuple(line[max(0, i - 2) : i]), line[i])) for i in range(1, len(line))) if w else 0.0)
    got = {r.k: (r.n_words, r.score) for r in lm.lm_scores(sentences(spark, asked), model_of(spark, TEXTS), "k", fn.words(F.col("text"))).collect()}
    assert got == {k: (n, pytest.approx(s)) for k, (n, s) in want.items()}
    r = spark.range(1).select(lm.perplexity(F.lit(-3.0), F.lit(0)).alias("a"), lm.perplexity(F.lit(-4.0), F.lit(2)).alias("b")).first()
    assert r.a == pytest.approx(1000) and r.b == pytest.approx(100)


def test_estimated_discounts(spark):
    # forty words once, twenty twice, ten three times, five four times
    rows = [(1, f"w{i}", 1 if i < 40 else 2 if i < 60 else 3 if i < 70 else 4) for i in range(75)] + [(2, "x y", 5)]
    got = {r.n: (r.d1, r.d2, r.d3) for r in lm.discounts(spark.createDataFrame(rows, "n int, gram string, c bigint")).collect()}
    y = 40 / 80
    assert got[1] == pytest.approx((1 - 2 * y * 20 / 40, 2 - 3 * y * 10 / 20, 3 - 4 * y * 5 / 10)) and got[2] == (0.5, 1.0, 1.5)


def test_no_sentences(spark):
    assert model_of(spark, ["", None, " "]).count() == 0


def test_wanted_grams_only(spark):
    """Estimates of some grams are those of the whole model, with the tails and weights that they need."""
    counts = lm.sentence_grams(sentences(spark, TEXTS), fn.words(F.col("text")))
    assert [r.n for r in counts.select("n").distinct().collect()] == [3]  # shorter grams are made from these
    whole = {r.gram: r for r in model_of(spark, TEXTS).collect()}
    asked = sorted(whole)[::3]
    got = {r.gram: r for r in lm.kneser_ney(counts, wanted=spark.createDataFrame([(g,) for g in [*asked, "no such gram"]], "gram string")).collect()}
    assert set(asked) <= set(got) and lm.UNKNOWN in got and len(got) < len(whole)
    assert all(r.n == whole[g].n and abs(r.p - whole[g].p) < 1e-12 and abs(r.backoff - whole[g].backoff) < 1e-12 for g, r in got.items())


def test_short_sentences_in_long_grams(spark):
    """Of four words: counts of sentences with three come from the sentences themselves."""
    counts = lm.sentence_grams(sentences(spark, ["a", "a", "a b", "b a b"]), fn.words(F.col("text")), 4)
    levels = [{r.gram: r.c for r in level.collect()} for level in lm.adjusted_counts(counts, 4)]
    assert levels[3] == {"<s> a b </s>": 1, "<s> b a b": 1, "b a b </s>": 1}
    assert levels[2] == {"<s> a </s>": 2, "<s> a b": 1, "<s> b a": 1, "a b </s>": 2, "b a b": 1}
    assert levels[1] == {"<s> a": 3, "<s> b": 1, "a </s>": 1, "a b": 2, "b </s>": 1, "b a": 1}
    assert levels[0] == {"a": 2, "b": 2, "</s>": 2}
