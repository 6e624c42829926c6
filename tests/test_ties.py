"""Rounding and ties as in SQL: cases where Spark's own functions give something else."""

import random

import duckdb
from pyspark.sql import functions as F

from voxloom.functions.numbers import rounded
from voxloom.operators import evaluation


def test_rounded_like_sql(spark):
    """Signs of zero, halves that have no binary notation, and what is no number or too large to scale."""
    r = random.Random(3)
    values = [-1e-9, -0.0, 0.0, 1e-9, 0.12345, 2.675, -2.675, 0.5e-6, 1.5e-6, 0.49999999999999994e-6, 1e300, float("inf"), float("nan"), None]
    values += [(2 * r.randrange(-(10**7), 10**7) + 1) / 2e6 for _ in range(3000)] + [r.gauss(0, 1) for _ in range(1000)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double").repartition(1)
    for digits in (1, 3, 6):
        got = [x[0] for x in rows.select(rounded("x", digits), "i").orderBy("i").collect()]
        want = [duckdb.execute(f"SELECT round(?::DOUBLE, {digits})", [v]).fetchone()[0] for v in values]
        assert [repr(x) for x in got] == [repr(x) for x in want]


def test_min_flip_ties(spark):
    rows = [("a", 0.5, float(k)) for k in (3, 1, 2)] + [("a", 0.7, 0.0), ("b", 0.1, 50.0), ("b", 0.1, 45.0), ("b", None, 1.0), ("c", None, 1.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "g string, e double, s double").coalesce(1)
        got = {r.g: (r.min_epsilon, r.snr_at_min, r.meets_snr) for r in evaluation.min_flip(df, "g", "e", "s", F.lit(True)).collect()}
        assert got == {"a": (0.5, 1.0, False), "b": (0.1, 45.0, True), "c": (None, None, None)}


def test_word_edits_hold_one_pair(monkeypatch):
    """The kernel of the edit distance makes Python strings of one pair at a time, whatever the batch."""
    import pyarrow as pa

    live, most = [0], [0]

    class Words(list):
        def __init__(self, x):
            super().__init__(x)
            live[0] += 1
            most[0] = max(most[0], live[0])

        def __del__(self):
            live[0] -= 1

    class Item:
        is_valid = True

        def as_py(self):
            return Words(["a", "b"])

    class Column(list):
        def to_pylist(self):
            return [x.as_py() for x in self]

    kernels = []
    monkeypatch.setattr(evaluation.F, "arrow_udf", lambda kind: lambda f: kernels.append(f) or (lambda *columns: None))
    evaluation.word_edits(None, None)
    assert kernels[0](Column([Item()] * 50), Column([Item()] * 50)).to_pylist() == [0] * 50
    assert most[0] <= 4
    got = kernels[0](pa.array([["a", "b"], None, ["a"]]), pa.array([["a", "c"], ["a"], ["b", "a"]]))
    assert got.to_pylist() == [1, None, 1]


def test_terms_without_phrases_leave_texts_where_they_are(spark):
    """Without terms of several words no text is shuffled, and words that are too short for any term aren't either."""
    from voxloom.operators import dictionary

    texts = spark.createDataFrame([(1, "a bb outermost"), (2, "rmost x"), (3, "bb"), (4, None)], "k int, t string")
    terms = spark.createDataFrame([("most",), ("term",), ("BB outer",)], "term string")
    single = terms.where("term <> 'BB outer'")
    for given, more in ((single, []), (terms, [(1, "bb outer")])):
        got = sorted(tuple(r) for r in dictionary.matches(texts, given, "k", "t").collect())
        assert got == sorted([(1, "most"), (1, "term"), (2, "most"), *more]), got
    plan = dictionary.matches(texts, single, "k", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "_z#" not in plan  # the shapes of phrases
