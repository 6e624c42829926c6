"""Grams in blocks against plain counts."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxloom.functions import text as fn
from voxloom.operators import corpus
from voxloom.operators import gram_blocks as blocks


def lines(texts):
    return pa.RecordBatch.from_arrays([pa.array([" ".join(t) + " " for t in texts], pa.string())], names=["words"])


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_blocks_go_over_their_ends(monkeypatch, block):
    """Grams that begin in a block and end in the next are whole, and rows are kept apart; buckets give back what was sent."""
    monkeypatch.setattr(blocks, "BLOCK", block)
    r = random.Random(block)
    texts = [[r.choice(["a", "é", "ccc", "日本", "w%d" % r.randrange(40)]) for _ in range(r.choice([0, 1, 2, 5, 30]))] for _ in range(60)]
    sent = {}
    for numbers, rest, words in blocks.word_blocks([lines(texts[:20]), lines([]), lines(texts[20:])], 2):
        none = len(words)
        columns = [np.array([numbers[i + k] if rest[i] >= k else none for i in range(len(rest))]) for k in range(3)]
        grams, counts = blocks.distinct(columns, none + 1)
        for bucket, row in blocks.packed(blocks.deal(blocks.hashes(words)[grams[0]], 5), grams, [counts], words):
            sent.setdefault(bucket, []).append(row)
    got = Counter()
    for rows in sent.values():
        words, grams, (counts,) = blocks.merged(rows, 3, 1)
        grams, counts = blocks.distinct(grams, len(words) + 1, counts)
        names = [*blocks.bare(words).to_pylist(), None]
        found = {tuple(names[g[i]] for g in grams): int(counts[i]) for i in range(len(counts))}
        assert not found.keys() & got.keys()
        got.update(found)
    assert got == Counter((t[i], *(t[i + k] if i + k < len(t) else None for k in (1, 2))) for t in texts for i in range(len(t)))


def test_texts_are_cut_at_white_space(spark):
    texts = ["a  b\tC d\r\n", None, "", " \n", "É\u00a0é a b", "\n\nx\fy <s> z", "b\x00 a"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r.n, r.gram): r.cnt for r in corpus.text_ngram_counts(d, F.col("text")).collect()}
    assert got == {(r.n, r.gram): r.cnt for r in corpus.ngram_counts(d, fn.words(F.col("text"))).collect()}
    assert got[3, "a b c"] == 1 and got[2, "a b"] == 2 and got[1, "é\u00a0é"] == got[1, "x\fy"] == 1


def test_numbers_too_large_to_be_packed():
    r = np.random.default_rng(1)
    columns = [r.integers(0, 9, 500) << 40 for _ in range(4)]
    want = Counter(zip(*(c.tolist() for c in columns)))
    got, counts = blocks.distinct(columns, 1 << 44)
    assert list(zip(*(c.tolist() for c in got))) == sorted(want) and counts.tolist() == [want[k] for k in sorted(want)]


def test_grams_travel_in_few_bytes(spark):
    """What is shuffled are rows of buckets, not a row for each gram."""
    r = random.Random(2)
    names = ["word%d" % min(int(1 / (r.random() + 1e-5)), 20_000) for _ in range(120_000)]
    d = spark.createDataFrame([(" ".join(names[i : i + 300]),) for i in range(0, len(names), 300)], "text string")
    got = corpus.ngram_counts(d, fn.words(F.col("text")))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Repartition" in plan
    size = 0
    for numbers, rest, words in blocks.word_blocks([lines([names[i : i + 300] for i in range(0, len(names), 300)])], 2):
        none = len(words)
        columns = [numbers, *(np.append(np.where(rest[:-k] >= k, numbers[k:], none), [none] * k) for k in (1, 2))]
        grams, counts = blocks.distinct(columns, none + 1)
        size += sum(len(row) for _, row in blocks.packed(blocks.deal(blocks.hashes(words)[grams[0]], 8), grams, [counts], words))
    assert size < 8 * len(names)  # three grams each, of 6 to 30 letters
    assert got.agg(F.sum(F.when(F.col("n") == 1, F.col("cnt")))).first()[0] == len(names)
