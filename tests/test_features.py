"""Clip features, labels of frames, splits, switches, alignment and edit distances, against plain computations."""

import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.operators import dictionary, evaluation, segments, signal
from voxloom.operators.ordered import nearest_marks
from voxloom.sources import storage

RNG = np.random.default_rng(8)


# --- features -----------------------------------------------------------------------------------------------


def clip_rows():
    good = [RNG.normal(size=n).tolist() for n in (64, 80, 48)]
    bad = [None, [], [1.0, None] * 40, [1.0] * 63 + [math.nan], [math.inf] * 64, [0.5] * 9, RNG.normal(size=40).tolist()]
    return list(enumerate([good[0], *bad[:4], good[1], *bad[4:], good[2], [0.0] * 64]))


def plain_slopes(x):
    n = len(x)
    out = []
    for t in range(n):
        c = min(max(t, 4), n - 5)
        out.append([sum(k * (x[c + k][j] - x[c - k][j]) for k in (1, 2, 3, 4)) / 60 for j in range(len(x[0]))])
    return out


def test_bad_clips_leave_the_others_unchanged(spark):
    rows = clip_rows()
    frame = lambda r: spark.createDataFrame(r, "k int, x array<double>").repartition(2)
    kernel = signal.lfcc(16, 4, 4, deltas=2)
    got = {r.clip: r for r in signal.clip_features(frame(rows), "k", "x", kernel).collect()}
    reasons = {k: r.reason for k, r in got.items() if r.reason}
    assert reasons == {1: "no samples", 2: "no samples", 3: "not a finite number", 4: "not a finite number", 6: "not a finite number", 7: "shorter than a frame", 8: "fewer than 9 frames"}
    alone = {r.clip: r for r in signal.clip_features(frame([r for r in rows if r[0] not in reasons]), "k", "x", kernel).collect()}
    assert alone == {k: r for k, r in got.items() if k not in reasons} and all(r.features is None and r.n_frames is None for k, r in got.items() if k in reasons)
    static = {r.clip: r.features for r in signal.clip_features(frame(rows), "k", "x", signal.lfcc(16, 4, 4)).collect()}
    for k, r in alone.items():
        assert (r.n_frames, r.n_coeffs) == (len(static[k]), 12)
        first = plain_slopes(static[k])
        assert np.allclose(r.features, np.concatenate((static[k], first, plain_slopes(first)), axis=1))


def test_counts_manifest_and_frames_of_features(spark):
    f = signal.clip_features(spark.createDataFrame(clip_rows(), "k int, x array<double>"), "k", "x", signal.lfcc(16, 4, 4, deltas=2))
    assert tuple(signal.feature_counts(f).first()) == (4, 7)
    assert {tuple(r) for r in signal.feature_manifest(f).collect()} == {(0, 13, 12), (5, 17, 12), (9, 9, 12), (10, 13, 12)}
    assert signal.feature_frames(f).count() == 13 + 17 + 9 + 13 and {r.clip for r in signal.quarantined(f).collect()} == {1, 2, 3, 4, 6, 7, 8}


def test_what_a_kernel_fails_with_is_the_clips_reason(spark):
    def kernel(x):
        return np.ones((2, 2)) / (0 if x[0] > 1 else 1) if x[0] != 3 else {}["no such key"]

    rows = [(0, [0.0]), (1, [2.0]), (2, [3.0])]
    got = {r.clip: r.reason for r in signal.clip_features(spark.createDataFrame(rows, "k int, x array<double>"), "k", "x", kernel).collect()}
    assert got[0] is None and got[1] == "features are no finite numbers" and got[2].startswith("KeyError")
    none = signal.clip_features(spark.createDataFrame([], "k int, x array<double>"), "k", "x", kernel)
    assert none.count() == 0 and tuple(signal.feature_counts(none).first()) == (0, 0)


def test_mel_levels(spark):
    loud = np.sin(2 * np.pi * 4 * np.arange(64) / 16)
    rows = [(0, loud.tolist()), (1, (loud * 0.5).tolist()), (2, [0.0] * 64)]
    got = {r.clip: np.array(r.features) for r in signal.clip_features(spark.createDataFrame(rows, "k int, x array<double>"), "k", "x", signal.logmel(16, 4, 6, 16.0)).collect()}
    assert np.allclose(got[0], got[1]) and got[0].max() == 0 and got[0].min() >= -80 and (got[2] == 0).all()


def test_linear_filters():
    f = np.array(signal.linear_filters(4, 33))
    assert f.shape == (4, 33) and (f.max(1) == 1).all() and (f >= 0).all()
    # edges 0, 6, 12: six bins up to one, six down to nothing
    assert np.allclose(f[0], [0, 0.2, 0.4, 0.6, 0.8, 1, 1, 0.8, 0.6, 0.4, 0.2, 0, *[0] * 21])


def test_labels_of_another_rate(spark):
    frames = spark.createDataFrame([(0, i, [float(i)]) for i in range(10)] + [(1, 0, [9.0])], "clip int, frame_idx int, vec array<double>")
    labels = spark.createDataFrame([(0, i, f"l{i}") for i in range(6)] + [(2, 0, "x")], "clip int, frame_idx int, label string")
    timed = signal.label_frames(frames, labels, (7, 5))
    assert {r.frame_idx: r.label for r in timed.collect()} == {t: f"l{t * 5 // 7}" for t in range(10) if t * 5 // 7 < 6}
    own = signal.label_frames(frames, labels)
    assert {r.frame_idx: r.label for r in own.collect()} == {t: f"l{t}" for t in range(6)}
    assert {tuple(r) for r in signal.label_manifest(frames, labels, own, 7).collect()} == {(0, 10, 6, 6, 0.857), (1, 1, 0, 0, 0.0), (2, 0, 1, 0, 0.0)}


def test_deltas_of_rows(spark):
    x = RNG.normal(size=15)
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, 1.0) for i in range(8)], "doc string, frame_idx int, x double")
    got = {(r.doc, r.frame_idx): r.features for r in segments.with_deltas(d, "x").collect()}
    first = plain_slopes(x[:, None].tolist())
    want = np.concatenate((x[:, None], first, plain_slopes(first)), axis=1)
    assert all(np.allclose(got["a", i], want[i]) for i in range(15)) and all(got["b", i] is None for i in range(8))


# --- splits -------------------------------------------------------------------------------------------------


def test_exact_splits_of_all_rows(spark):
    for n in (1, 2, 3, 10, 997):
        d = spark.range(n).withColumn("_rank_of", F.col("id")).repartition(3)
        for seed in ("42", None):
            got = segments.split_exact(d, "id", seed=seed)
            assert got.columns == [*d.columns, "split"]
            rows = {r.id: r.split for r in got.collect()}
            assert len(rows) == n and Counter(rows.values()) == Counter({k: v for k, v in (("train", int(0.8 * n)), ("valid", int(0.1 * n)), ("test", n - int(0.8 * n) - int(0.1 * n))) if v})
            if seed is None:
                assert [rows[i] for i in range(n)] == sorted(rows.values(), key=["train", "valid", "test"].index)
    one, other = ({r.id for r in segments.split_exact(spark.range(500), "id", seed=s).where("split = 'test'").collect()} for s in ("1", "2"))
    assert one != other and one == {r.id for r in segments.split_exact(spark.range(500).repartition(7), "id", seed="1").where("split = 'test'").collect()}


def test_exact_splits_of_classes(spark):
    sizes = {"one": 1, "two": 2, "three": 3, "many": 411, None: 20}
    rows = [(f"{label}{i}", label) for label, n in sizes.items() for i in range(n)]
    got = segments.split_exact(spark.createDataFrame(rows, "k string, label string"), "k", (0.7, 0.15), "label", least=1).collect()
    count = Counter((r.label, r.split) for r in got)
    assert {k: v for k, v in count.items() if k[0] in ("one", "two", "three")} == {("one", "train"): 1, ("two", "train"): 1, ("two", "valid"): 1, ("three", "train"): 2, ("three", "valid"): 1}
    assert [count["many", s] for s in ("train", "valid", "test")] == [287, 61, 63] and [count[None, s] for s in ("train", "valid", "test")] == [14, 3, 3]


# --- switches and windows -----------------------------------------------------------------------------------


def test_nearest_marks_across_ranges(spark):
    times = sorted(RNG.integers(0, 400, 300).tolist())
    rows = [("d", float(t), bool(RNG.random() < 0.1)) for t in times] + [("e", 1.0, False), ("f", 2.0, True), (None, 3.0, True)]
    got = nearest_marks(spark.createDataFrame(rows, "doc string, time double, m boolean").repartition(3), "doc", "time", F.col("m")).collect()
    marks = lambda doc: [t for d, t, m in rows if d == doc and m]
    assert len(got) == len(rows)
    for r in got:
        assert (r.before, r.after) == (max((t for t in marks(r.doc) if t <= r.time), default=None), min((t for t in marks(r.doc) if t >= r.time), default=None))


def test_switches_of_one_very_long_document(spark):
    n = 1_000_000
    both = spark.range(n).select(F.lit(1).alias("doc"), (F.col("id") * 0.5).alias("time"), "id")
    t = time.time()
    r = segments.join_nearest_switch(both.where("id % 2 = 0"), both.where("id % 4 = 1")).agg(F.count("*").alias("n"), F.max("error_ms").alias("most"), F.min("error_ms").alias("least")).first()
    assert (r.n, r.least, r.most) == (n // 2, 500, 500) and time.time() - t < 120


def test_best_window_of_short_documents(spark):
    rows = [("long", i, x) for i, x in enumerate("aabbbbaa")] + [("short", i, x) for i, x in enumerate("aba")] + [("none", 0, "a")]
    d = spark.createDataFrame(rows, "doc string, frame_idx int, label string")
    got = {r.doc: (r.start, r.share, r.n_padded) for r in segments.best_window(d, F.col("label") == "b", 4, 2).collect()}
    assert got == {"long": (2, 1.0, 0), "short": (0, 0.25, 1), "none": (0, 0.0, 3)}


# --- dictionaries -------------------------------------------------------------------------------------------


def test_headers_of_dictionaries(spark):
    files = {
        "header": ["# terms", "english_term\tlocal name", "", "dog\tkutta 1", " \t ", "cat\tbilli"],
        "none": ["dog\tkutta2", "cat\tbilli"],
        "one column": ["term", "dog"],
        "empty": ["", "# only"],
        "empty cell": ["english\t\tlocal", "dog\tx"],
    }
    rows = [(name, i, x) for name, lines in files.items() for i, x in enumerate(lines)]
    got = {r.f: (r.entries, r["pass"]) for r in evaluation.dictionary_size(spark.createDataFrame(rows, "f string, i int, x string"), "f", "x", "i", 2).collect()}
    assert got == {"header": (2, True), "none": (2, True), "one column": (2, True), "empty": (0, False), "empty cell": (2, True)}


def test_more_than_a_hundred_thousand_terms(spark):
    n = 120_000
    terms = spark.range(n).select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("term"))
    asked = [0, 7, 99_999, n - 1]
    texts = [(i, f"x{k}y Tt{k:06d}0 and t{k:06d} two") for i, k in enumerate(asked)] + [(9, f"t{n + 5:06d}")]
    d = spark.createDataFrame(texts, "k int, t string")
    found = dictionary.matches(d, terms, "k", "t")
    assert {(r.k, r.term) for r in found.collect()} == {(i, f"t{k:06d}") for i, k in enumerate(asked)}
    first = dictionary.term_first(d, terms, "k", "t", "t").collect()
    assert {r.term: r.k for r in first} == {f"t{k:06d}": i for i, k in enumerate(asked)}


# --- kernels ------------------------------------------------------------------------------------------------


def plain_path(x, y, band):
    n, m = len(x), len(y)
    width = max(int(band * max(n, m)), abs(n - m) + 1)
    total = {(0, 0): 0.0}
    at = lambda i, j: total.get((i, j), math.inf)
    for i in range(1, n + 1):
        for j in range(max(1, i - width), min(m, i + width) + 1):
            cost = float(((x[i - 1] - y[j - 1]) ** 2).sum())
            total[i, j] = (0.0 if math.isnan(cost) else cost) + min(at(i - 1, j - 1), at(i - 1, j), at(i, j - 1))
    out, i, j = [], n, m
    while i and j:
        out.append((i - 1, j - 1))
        step = int(np.argmin([at(i - 1, j - 1), at(i - 1, j), at(i, j - 1)]))
        i, j = i - (step != 2), j - (step != 1)
    return out[::-1]


def test_alignment_by_antidiagonals():
    for k in range(60):
        n, m = RNG.integers(1, 30, 2)
        draw = (lambda size: RNG.integers(0, 3, size).astype(float)) if k % 2 else (lambda size: RNG.normal(size=size))
        x, y = (draw((int(s), 2)) if k % 5 == 0 else draw(int(s)) for s in (n, m))
        if k % 3 == 0:
            x[RNG.integers(0, n)] = np.nan
        band = (0.25, 1.0, 0.05)[k % 3]
        assert signal.path(x, y, band) == plain_path(x, y, band)


def test_alignment_of_long_contours():
    import tracemalloc

    x, y = np.sin(np.arange(5000) / 50) + RNG.normal(size=5000) / 9, np.sin(np.arange(5000) / 52)
    t = time.process_time()
    p = signal.path(x, y)
    assert time.process_time() - t < 5 and p[0] == (0, 0) and p[-1] == (4999, 4999)
    tracemalloc.start()
    assert signal.path(x, y) == p and tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()


def test_edits_of_long_texts():
    many = [f"w{i}" for i in RNG.zipf(1.3, 20_000) % 5000]
    other = [w if RNG.random() > 0.2 else "x" for w in many]
    t = time.process_time()
    e = evaluation.edits(many, other)
    assert time.process_time() - t < 5 and e == evaluation.edits(other, many) and 3000 < e < 4500
    r, h = (np.array(x[:900]) for x in (many, other))  # row by row
    at = np.arange(len(h) + 1)
    row = at
    for i, w in enumerate(r, 1):
        row = np.minimum.accumulate(np.concatenate(([i], np.minimum(row[1:] + 1, row[:-1] + (h != w)))) - at) + at
    assert evaluation.edits(r.tolist(), h.tolist()) == row[-1]


def test_scratch_is_removed(spark):
    before = storage.len_scratch()
    kept = storage.kept(spark.range(5), "five")
    path = storage._made[-1]
    assert kept.count() == 5 and storage.remove_scratch(spark, before) == 1 and storage.len_scratch() == before
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
