"""Queries over whole inputs, against brute force on small tables of their own."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from voxloom.functions import text as fn
from voxloom.operators import dictionary, evaluation, segments, signal


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def table(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_error_rates_of_whole_turns(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(40))
    turns = [long, long.replace("w35", "x"), long + " é", long + " à", " " * 70 + "late", "b"]
    table(spark, tmp_path, "conversations", [(1, i, "user", x) for i, x in enumerate(turns)], "conv_id bigint, turn bigint, role string, text string")
    pairs = list(zip(turns, turns[1:]))
    got = entry.queries()["agg_wer"](spark, str(tmp_path)).where("mode = 'pairs' AND role = 'overall'").first()
    assert (got.edits, got.words) == (sum(_edits(a.split(), b.split()) for a, b in pairs), sum(len(a.split()) for a, _ in pairs))
    cer = {r.turn: r.cer for r in entry.queries()["agg_cer"](spark, str(tmp_path)).collect()}
    assert cer == {i: pytest.approx(_edits(a, b) / len(a), abs=1e-4) for i, (a, b) in enumerate(pairs)}
    assert cer[2] > 0  # é is not à
    assert {r.turn for r in entry.queries()["filter_text_pairs"](spark, str(tmp_path)).collect()} == set(range(5))


def test_word_edits_of_more_words_than_letters(spark):
    many = " ".join(f"w{i}" for i in range(31_005))
    pairs = [("w7 w9 y", many), ("w1 w2", "w2 w1 w1"), ("", "a")]
    d = spark.createDataFrame(pairs, "r string, h string").select(evaluation.word_edits(fn.words(F.col("r")), fn.words(F.col("h"))).alias("e"))
    assert [r.e for r in d.collect()] == [31_003, 2, 1]
    for a, b in (("kitten", "sitting"), ("", "ab"), ("ab", ""), ("abcdef", "azced")):
        assert evaluation.edits(list(a), list(b)) == _edits(a, b)


EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def test_alignment_of_whole_contours(spark, tmp_path):
    start = datetime(2024, 1, 1)
    values = {0: [math.sin(i / 9) for i in range(230)], 1: [math.sin(i / 8) for i in range(210)]}
    events = [(1000 * u + i, start + timedelta(seconds=i), u, "view", v) for u, x in values.items() for i, v in enumerate(x)]
    table(spark, tmp_path, "events", events, EVENT)
    rng = np.random.default_rng(3)
    clips = {0: rng.normal(size=(50, 2)), 1: rng.normal(size=(44, 2))}
    table(spark, tmp_path, "embeddings", [(50 * c + i, v.tolist(), c) for c, x in clips.items() for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    want = signal.path(np.array(values[0]), np.array(values[1]))
    got = entry.queries()["job_align_series"](spark, str(tmp_path)).orderBy("path_ord").collect()
    assert [(r.src_idx, r.tgt_idx) for r in got] == want
    last = dict(want)
    warped = entry.queries()["job_warp_contour"](spark, str(tmp_path)).collect()
    assert {r.frame_idx: r.value for r in warped} == {i: values[1][last[i]] for i in range(230)}
    steps = signal.path(clips[0][:, 0], clips[1][:, 0])
    mcd = signal.MCD * np.mean([np.linalg.norm(clips[0][i] - clips[1][j]) for i, j in steps])
    assert entry.queries()["job_mcd_corpus"](spark, str(tmp_path)).first().mcd == pytest.approx(mcd, abs=1e-3)


def test_one_stride_for_a_pair(spark):
    side = lambda n: spark.createDataFrame([(0, i) for i in range(n)], "pair int, frame_idx int")
    a, b = segments.stride_pair(side(35), side(12), most=10)
    assert [sorted(r.frame_idx for r in x.collect()) for x in (a, b)] == [list(range(0, 35, 3)), [0, 3, 6, 9]]


def test_lookup_falls_through(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    terms = frame([("Mined",), ("Exact",), ("Lower",), ("None",)], ["term"])
    entries = frame([("Mined", "x"), ("Exact", "e"), ("exact", "no"), ("lower", "l")], ["key", "value"])
    got = dictionary.lookup(terms, entries, frame([("Mined", "m")], ["term", "value"]))
    assert {r.term: r.value for r in got.collect()} == {"Mined": "m", "Exact": "e", "Lower": "l", "None": "[TRANSLATE:None]"}


def test_frames_up_to_the_last_segment(spark, tmp_path):
    start, hour = datetime(2024, 1, 1), timedelta(hours=1)
    # an hour is a frame, and a value of 6 an hour
    events = [(0, start, 1, "view", 6.0), (1, start + 299 * hour, 1, "purchase", 12.0), (2, start, 2, "click", 18.5)]
    table(spark, tmp_path, "events", events, EVENT)
    got = {(r.doc, r.frame_idx): r.label for r in entry.queries()["join_frame_labels"](spark, str(tmp_path)).collect()}
    want = {(1, i): "silence" for i in range(301)} | {(1, 0): "view", (1, 299): "purchase", (1, 300): "purchase"} | {(2, i): "click" for i in range(3)}
    assert got == want


def test_terms_beyond_the_most_frequent(spark, tmp_path):
    terms = [f"{a}{b}common" for a in "abcd" for b in "abcdefgh"]
    docs = [(i, f"{w} x{w}y short {w[1:]}", f"l{i}") for i, w in enumerate(terms)]
    items = [(i, f"an {w}s") for i, w in enumerate(terms[::2])]
    table(spark, tmp_path, "documents", docs, "doc_id bigint, text string, lang string")
    table(spark, tmp_path, "benchmark", items, "item_id bigint, text string")
    words = {w for _, x, _ in docs for w in x.split() if len(w) >= 6}
    hits = {(i, w) for i, x, _ in docs for w in words if w in x}
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.term) for r in run("join_term_all")) == sorted(hits)
    first = {w: min(i for i, v in hits if v == w) for w in words}
    assert {r.term: (r.lang, r.doc_id) for r in run("join_term_first")} == {w: (f"l{i}", i) for w, i in first.items()}
    assert [r.term for r in run("join_unmined")] == sorted(w for w in words if not any(w in x for _, x in items))
