"""The whole language model from grams in blocks, against a plain estimate."""

import random

import pytest
from pyspark.sql import functions as F
from test_language_model import TEXTS, plain, sentences

from voxloom.operators import language_model as lm
from voxloom.operators import whole_model


def model_of(spark, texts, **options):
    rows = whole_model.estimate(sentences(spark, texts), F.col("text"), **options).collect()
    assert len({r.gram for r in rows}) == len(rows) and all(r.n == len(r.gram.split(" ")) for r in rows)
    return {tuple(r.gram.split(" ")): (r.p, r.backoff) for r in rows}


def mixed():
    r = random.Random(4)
    return [" ".join(r.choice(["the", "of", "é", "w%d" % min(int(1 / (r.random() + 0.001)), 300)]) for _ in range(r.choice([0, 1, 2, 9, 40]))) for _ in range(120)] + ["a <s> b </s>", "<unk>", "<s>", "x</s> <s> \t</S>\n y  <s>", None]


@pytest.mark.parametrize("texts", [TEXTS, mixed()], ids=["few", "mixed"])
@pytest.mark.parametrize("options", [{"buckets": 3, "sites": {}}, {"buckets": 5, "sites": {"a": 2, "the": 3, "of": 2, "w1": 4, "absent": 2}}, {}], ids=["one site", "several sites", "sampled"])
def test_every_gram_is_that_of_a_plain_estimate(spark, texts, options):
    """Words with several sites have the same estimates; those are read from the table if they aren't given."""
    p, b = plain([" ".join(w for w in (t or "").lower().split() if w not in (lm.BEGIN, lm.END, lm.UNKNOWN)) for t in texts])
    got = model_of(spark, texts, **options)
    assert got.keys() == p.keys()
    for g, x in p.items():
        assert got[g] == (pytest.approx(x, rel=1e-9), pytest.approx(b.get(g, 1.0), rel=1e-9)), g


def test_only_grams_of_three_words_are_sent_by_texts(spark):
    """Rows that travel hold the grams of a block and a site, not one gram each, and none is grouped by its string."""
    got = whole_model.estimate(sentences(spark, TEXTS), F.col("text"), sites={})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and "CoGroup" in plan


@pytest.mark.parametrize("texts", [["", None, " ", "<s>"], []])
def test_no_sentences(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    assert [tuple(r) for r in whole_model.estimate(table, F.col("text")).collect()] == [(1, "<s>", 0.0, 1.0)]


def test_words_with_several_sites(spark):
    table = sentences(spark, ["the cat the dog the end"] * 20)
    assert whole_model.common_words(table, F.col("text"), 4, 100) == {"the": 2}
