"""Hand-made edge rows for the operators."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.functions import text as fn
from voxloom.operators import corpus, dictionary, evaluation, segments, signal
from voxloom.operators.ordered import running_sums
from voxloom.sources import readers


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_pairs_keep_whitespace_only_sides_and_last_duplicates(spark):
    d = spark.createDataFrame([(0, " a ", "b"), (1, "", "x"), (2, "  ", "y"), (3, None, "z"), (4, "a", "b")], "i int, en string, tgt string")
    n = corpus.normalize_pairs(d, ["src", "en"], ["tgt", "mai"], keep=("i",))
    assert rows(n, "i") == [("a", "b", 0), ("", "y", 2), ("a", "b", 4)]
    assert rows(corpus.dedup_pairs(n, "src", "tgt", "i").select("i"), "i") == [(0,), (2,)]


def test_ngrams_of_short_sentences(spark):
    d = spark.createDataFrame([("a b",), ("",), (None,), ("a",)], "text string")
    got = corpus.ngram_counts(d, fn.words(F.col("text")))
    assert rows(got, "n", "cnt") == [(1, "b", 1), (1, "a", 2), (2, "a b", 1)]


def test_ngrams_are_made_without_lambdas_and_counted_in_bounded_tasks(spark, tmp_path):
    texts = ["a b a b a", "x", None, " ", "a  b\tc d e"] + ["b a"] * 40
    spark.createDataFrame([(t, "y" * 300) for t in texts], "text string, other string").coalesce(1).write.parquet(str(tmp_path / "d"))
    d = spark.read.parquet(str(tmp_path / "d"))
    for max_n in (1, 2, 4):
        got = corpus.ngram_counts(d, fn.words(F.col("text")), max_n)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1 and "zip_with" not in plan
        tokens = [(t or "").split() for t in texts]
        want = Counter((n, " ".join(w[i : i + n])) for w in tokens for n in range(1, max_n + 1) for i in range(len(w) - n + 1))
        assert {(r.n, r.gram): r.cnt for r in got.collect()} == want
    parts = readers.dealt(d, 100)
    assert parts.rdd.getNumPartitions() > 1 == readers.dealt(d).rdd.getNumPartitions()
    assert sorted(rows(parts), key=str) == sorted(rows(d), key=str)


def test_balance_and_script(spark):
    d = spark.createDataFrame([(i, int(i < 3)) for i in range(40)], "k int, y int")
    got = corpus.balance_classes(d, "y", "k").groupBy("y").count()
    assert rows(got, "y") == [(0, 3), (1, 3)]
    s = spark.createDataFrame([("नमस्ते ab",), ("abc",), ("12",)], "t string").select(fn.script_language(F.col("t")))
    assert [r[0] for r in s.collect()] == ["hi", "en", "en"]


def test_runs_absorb_and_switches(spark):
    labels = "aabccccb"
    f = spark.createDataFrame([("d", i, c, float(i)) for i, c in enumerate(labels)], "doc string, frame_idx int, label string, confidence double")
    runs = segments.frame_runs(f)
    assert rows(runs.select("label", "start_frame", "end_frame"), "start_frame") == [("a", 0, 2), ("b", 2, 3), ("c", 3, 7), ("b", 7, 8)]
    assert rows(segments.absorb_short(runs, 2).select("label", "start_frame", "end_frame"), "start_frame") == [("a", 0, 3), ("c", 3, 8)]
    short_first = segments.absorb_short(runs, 3).select("label", "start_frame", "end_frame")
    assert rows(short_first, "start_frame") == [("a", 0, 3), ("c", 3, 8)]
    s = f.select("doc", F.col("frame_idx").alias("seg_idx"), F.col("label").alias("language"), F.col("confidence").alias("start_time"))
    assert [r.time for r in segments.switch_points(s).orderBy("time").collect()] == [2.0, 3.0, 7.0]


def test_intervals(spark):
    kind = "doc string, seg_idx int, start_time double, end_time double, language string"
    a = spark.createDataFrame([("d", 0, 0.0, 10.0, "x"), ("d", 1, 20.0, 21.0, "y"), ("e", 0, 0.0, 1.0, "z")], kind)
    b = spark.createDataFrame([("d", 0, 0.0, 5.0, "first"), ("d", 1, 5.0, 10.0, "second"), ("d", 2, 10.0, 20.0, "touches")], kind)
    got = segments.join_max_overlap(a, b, 3.0)
    assert rows(got.select("doc", "seg_idx", "label"), "doc", "seg_idx") == [("d", 0, "first"), ("d", 1, "y"), ("e", 0, "z")]
    near = segments.join_nearest_midpoint(a, b, 5.0)
    assert rows(near.select("doc", "seg_idx", "ref_idx", "dist"), "seg_idx") == [("d", 0, 0, 2.5)]
    none = segments.join_nearest_switch(a.select("doc", F.col("start_time").alias("time")), b.select("doc", F.col("start_time").alias("time")).where("doc = 'd'"))
    assert {r.doc: r.error_ms for r in none.where("doc = 'e'").collect()} == {"e": math.inf}


def test_slices_of_short_clips(spark):
    d = spark.createDataFrame([(3,), (10,), (12,)], "n int")
    n = F.col("n")
    got = d.select(F.size(segments.sliding(n, 10, 5)), F.size(segments.padded(n, 10, 5, 2)), F.size(segments.tumbling(n, 5, 3)), F.size(segments.sliding_tail(n, 10, 5, 2)))
    assert rows(got) == [(0, 1, 1, 1), (1, 1, 2, 2), (1, 1, 2, 2)]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_word_edits(spark):
    pairs = [("the cat sat on", "the cat sit on mat"), ("a", ""), ("x y z", "z y x"), ("é è", "è é é")]
    d = spark.createDataFrame(pairs, "r string, h string").select("r", "h", evaluation.word_edits(fn.words(F.col("r")), fn.words(F.col("h"))).alias("e"))
    for r in d.collect():
        assert r.e == _edits(r.r.split(), r.h.split())


@pytest.mark.parametrize("data, want", [([(1, 0.9), (1, 0.8), (0, 0.2)], 0.0), ([(0, 0.9), (1, 0.1)], 1.0), ([(1, 0.5), (1, 0.4)], 0.5)])
def test_eer_of_perfect_inverted_and_one_class_scores(spark, data, want):
    d = spark.createDataFrame(data, "y int, s double")
    assert evaluation.eer(d, "y", "s").first().eer == pytest.approx(want)


def test_prf_with_an_absent_class(spark):
    d = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "g string, p string")
    got = {r.label: r for r in evaluation.prf(d, "g", "p", ["a", "b", "c"]).collect()}
    assert got["c"].f1 == 0 and got["a"].precision == 1 and got["a"].recall == 0.5 and got["a"].macro_f1 == pytest.approx((2 / 3 + 2 / 3) / 3)


def test_terms_against_plain_loops(spark):
    import random

    draw = random.Random(4)
    some = [" ".join("".join(draw.choices("abc", k=draw.randint(1, 4))) for _ in range(draw.randint(0, 7))) for _ in range(40)]
    texts = [*some, "Neural network here", "net", "", None, "networks of  abc", "learning deep", " a  b\nc "]
    looked = ["network", "net", "deep learning", "abc", "a", "b c", "a b c", "", "ab cab", "a  b", "b\nc", "AB", *some[:5]]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    terms = spark.createDataFrame([(x,) for x in looked], "term string")
    body = {k: (t or "").strip(" ").lower() for k, t in enumerate(texts)}
    clean = {x.lower() for x in looked if x}
    inside = {(k, x) for k, t in body.items() for x in clean if x in t}
    got = rows(dictionary.matches(d, terms, "k", "t"))
    assert len(got) == len(set(got)) and set(got) == inside
    every = {(k, x) for k, t in body.items() for x in clean if " " in x and set(x.split()) <= set(t.split())}
    assert set(rows(dictionary.matches(d, terms, "k", "t", words=True))) == inside | every
    spaced = lambda x: f" {' '.join(x.split())} "
    whole = {(k, " ".join(x.split())) for k, t in body.items() for x in clean if spaced(x) in spaced(t)}
    assert set(rows(dictionary.matches(d, terms, "k", "t", word_boundary=True))) == whole
    first = {x: min(k for k, y in inside if y == x) for _, x in inside}
    got = dictionary.term_first(d.withColumn("v", F.concat(F.lit("v"), "k")), terms, "k", "t", "v").collect()
    assert {r.term: (r.v, r.k) for r in got} == {x: (f"v{k}", k) for x, k in first.items()}


def test_running_sums_of_a_skewed_order(spark):
    values = [10.0**9, *(i / 7 for i in range(300)), -5.0]
    d = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "v double, c int")
    for down in (False, True):
        got = {r.v: r.c_before for r in running_sums(d, "v", ["c"], descending=down).collect()}
        at = 0
        for v, c in sorted(((v, i % 3) for i, v in enumerate(values)), reverse=down):
            assert got[v] == at
            at += c


def test_error_rates_overall_and_concatenated(spark):
    d = spark.createDataFrame([("a", 1, 0, "x y", "x z"), ("a", 1, 1, "z", "y z"), ("b", 1, 2, "q", "q"), ("b", 2, 0, "", "w")], "g string, doc int, i int, r string, h string")
    p = d.select("g", "doc", "i", fn.words(F.col("r")).alias("r"), fn.words(F.col("h")).alias("h"))
    assert {r.g: (r.edits, r.words) for r in evaluation.wer(p, "g", "r", "h").collect()} == {"a": (2, 3), "b": (0, 1), "overall": (2, 4)}
    whole = evaluation.concatenated(p, ["doc", "g"], "i", ["r", "h"])
    assert {r.g: (r.edits, r.words) for r in evaluation.wer(whole, "g", "r", "h").collect()} == {"a": (1, 3), "b": (0, 1), "overall": (1, 4)}
    assert [r.h for r in whole.where("g = 'a'").collect()] == [["x", "z", "y", "z"]]
    assert evaluation.wer(p.where("g = 'c'"), "g", "r", "h").count() == 0


def test_options(spark):
    texts = spark.createDataFrame([(1, "networks net,"), (2, "a net here"), (3, "the net"), (4, None)], "k int, t string")
    terms = spark.createDataFrame([("net",)], "term string")
    assert sorted(rows(dictionary.matches(texts, terms, "k", "t", word_boundary=True))) == [(2, "net"), (3, "net")]
    d = spark.createDataFrame([("dog", "[TRANSLATE:dog]", 2)], "k string, v string, o int")
    assert dictionary.usable_entries(d, "k", "v", "o").count() == 0 and dictionary.usable_entries(d, "k", "v", "o", strict_reference=True).count() == 1
    s = spark.createDataFrame([("d", i, x, i * 2.5, i * 2.5 + 5) for i, x in enumerate("aabb")], "doc string, seg_idx int, language string, start_time double, end_time double")
    assert [(r.start_time, r.end_time) for r in segments.merge_runs(s, clip_overlap=True).orderBy("run").collect()] == [(0.0, 5.0), (5.0, 12.5)]


def test_tagging_longest_first_and_restoring(spark):
    d = spark.createDataFrame([("Deep Net and net and deep",)], "text string")
    r = dictionary.tag_terms(d, "text", [("net", "N"), ("deep net", "DN"), ("deep", "D")]).first()
    assert r.tagged == "⟦0⟧ and ⟦2⟧ and ⟦1⟧" and [u.target for u in r.used] == ["DN", "D", "N"]
    back = spark.createDataFrame([(r.tagged + "⟦9⟧", ["DN", "D", "N"])], "t string, x array<string>").select(fn.restore_placeholders(F.col("t"), F.col("x"))).first()[0]
    assert back == "DN and N and D"


def test_dictionary_keys_and_phonetics(spark):
    d = spark.createDataFrame([(" Cat", "x", 0), ("cat", "y", 1), ("dog", "[TRANSLATE:dog]", 2), ("", "z", 3)], "k string, v string, o int")
    assert rows(dictionary.usable_entries(d, "k", "v", "o")) == [("cat", "y")]
    table = [("sch", "S"), ("s", "s"), ("ch", "X"), ("c", "k"), ("c", "k"), ("s", "a"), (None, "n"), ("x", None)]
    words = ["schach", "sc", "", "xyz", "ab"]
    got = dictionary.phonetise(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(table, "key string, value string"), spark.createDataFrame([("ab", "AB")], "key string, value string"))
    assert dict(rows(got)) == {"schach": "SaX", "sc": "sk", "": "", "xyz": "xyz", "ab": "AB"}


def test_silent_and_short_clips(spark):
    d = spark.createDataFrame([(0, [0.0] * 4), (1, [1.0, -1.0])], "k int, x array<float>")
    s = {r.k: r for r in signal.clip_stats(d, "x", F.lit(2)).collect()}
    assert s[0].rms == 0 and s[0].noise == 0 and s[1].rms == 1 and s[1].snr is None
    assert d.select(signal.peak_normalize(F.col("x"))).first()[0] == [0, 0, 0, 0]


def test_spectrum_kernel(spark):
    x = np.random.default_rng(0).normal(size=(3, 64))
    f = spark.createDataFrame([("c", i, v.tolist()) for i, v in enumerate(x)], "clip string, frame_idx int, vec array<double>")
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(64) / 64)
    want = np.abs(np.fft.rfft(x * hann)) ** 2
    got = np.array([r.power for r in signal.power_spectrum(f, 64).orderBy("frame_idx").collect()])
    assert np.allclose(got, want)
    long = spark.createDataFrame([("c", 0, np.sin(2 * np.pi * 8 * np.arange(128) / 128).tolist())], "clip string, frame_idx int, vec array<double>")
    assert int(np.argmax(signal.power_spectrum(long, 128).first().power)) == 8


def test_alignment_against_a_plain_recurrence(spark):
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (5, 9), (12, 7)):
        x, y = rng.normal(size=n), rng.normal(size=m)
        p = signal.path(x, y, band=1.0)
        cost = np.full((n + 1, m + 1), np.inf)
        cost[0, 0] = 0
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                cost[i, j] = (x[i - 1] - y[j - 1]) ** 2 + min(cost[i - 1, j - 1], cost[i - 1, j], cost[i, j - 1])
        assert sum((x[i] - y[j]) ** 2 for i, j in p) == pytest.approx(cost[n, m])
        assert p[0] == (0, 0) and p[-1] == (n - 1, m - 1)
    a = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 2.0, 3.0])], "pair int, frame_idx int, value double")
    b = spark.createDataFrame([(0, i, v) for i, v in enumerate([1.0, 1.0, 3.0])], "pair int, frame_idx int, value double")
    w = signal.warp(signal.align(a, b), a, b)
    assert len(rows(w)) == 3
