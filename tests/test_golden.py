"""Published values, replayed: a transcript of 88 segments, a trade-off curve, a training history and the gates of an evaluation."""

import json
import os

import pytest

from voxloom.operators import evaluation, segments

with open(os.path.join(os.path.dirname(__file__), "golden", "values.json")) as f:
    VALUES = json.load(f)


@pytest.fixture(scope="module")
def transcript(spark):
    rows = [("t", i, *x) for i, x in enumerate(VALUES["segments"])]
    return spark.createDataFrame(rows, "doc string, seg_idx int, start_time double, end_time double, language string")


def test_switches_of_the_transcript(transcript):
    assert [r.time for r in segments.switch_points(transcript).orderBy("seg_idx").collect()] == [36.94, 40.0, 301.32, 305.0]


def test_rollup_of_the_transcript(transcript):
    r = segments.rollup(transcript).first()
    assert (r.num_segments, r.total_duration, r.n_languages) == (88, 651.98, 2)


def test_smallest_flip(spark):
    d = spark.createDataFrame([("c", *x) for x in VALUES["curve"]], "run string, iteration int, epsilon double, snr double, flipped boolean")
    r = evaluation.min_flip(d, "run", "epsilon", "snr", d["flipped"]).first()
    assert r.min_epsilon == 0.000100095272064209 and r.snr_at_min == pytest.approx(61.466584271916) and r.meets_snr


def test_best_epoch_is_the_first_of_equals(spark):
    d = spark.createDataFrame([("h", *x) for x in VALUES["history"]], "run string, epoch int, macro_f1 double")
    assert evaluation.best_epoch(d, "run", "epoch", "macro_f1").first().epoch == 5


def test_gates(spark):
    rows = [(m, None if v is None else float(v), None if t is None else float(t), x) for m, v, t, x in VALUES["metrics"]]
    d = spark.createDataFrame(rows, "metric string, value double, threshold double, largest boolean")
    passed = [r["pass"] for r in evaluation.metric_gates(d.select("metric", "value"), d.select("metric", "threshold", "largest")).collect()]
    assert (passed.count(True), passed.count(False), passed.count(None)) == (4, 3, 1)
