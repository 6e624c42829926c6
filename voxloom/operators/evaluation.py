"""Error rates, detection curves, confusion counts, gates and coverage checks."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from .ordered import running_sums

#: Masks of words that are kept; those of rarer words are made again from their few places.
_MASKS = 1024


def edits(reference: list, hypothesis: list) -> int:
    """Edit distance of two lists, bit-parallel (Myers): a column of the table is two integers of a bit for each item of one
    list, the places where the distance rises and falls by one, and an item of the other list is a few operations on them."""
    a, b = (reference, hypothesis) if len(reference) <= len(hypothesis) else (hypothesis, reference)
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a[head:]), reversed(b[head:]))) if x != y), len(a) - head)
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a:
        return len(b)
    places: dict = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)

    @lru_cache(_MASKS)
    def mask(word) -> int:
        bits = np.zeros(len(a), np.uint8)
        bits[places[word]] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    full, last, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    rise, fall = full, 0
    for w in b:
        same = mask(w) if w in places else 0
        diagonal = (((same & rise) + rise) ^ rise) | same | fall
        up, down = fall | (full & ~(diagonal | rise)), rise & diagonal
        distance += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & full, down << 1 & full
        across = same | fall
        rise, fall = down | (full & ~(across | up)), up & across
    return distance


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of two word arrays, of any number of words, in an Arrow kernel."""

    @F.arrow_udf("int")
    def distance(r: pa.Array, h: pa.Array) -> pa.Array:
        # pair by pair: the words of a whole batch as Python strings take many times its size
        return pa.array((edits(a.as_py(), b.as_py()) if a.is_valid and b.is_valid else None for a, b in zip(r, h)), pa.int32())

    return distance(reference, hypothesis)


def wer(pairs: DataFrame, group: str, reference: str, hypothesis: str, overall: str = "overall") -> DataFrame:
    """(group, edits, words, wer) over word arrays: pooled edits by pooled words, and a row for all groups. Pairs with
    an empty side don't count."""
    p = pairs.where((F.size(reference) > 0) & (F.size(hypothesis) > 0)).select(F.coalesce(F.col(group), F.lit("")).alias(group), word_edits(F.col(reference), F.col(hypothesis)).alias("e"), F.size(reference).alias("n"))
    out = p.rollup(group).agg(F.sum("e").alias("edits"), F.sum("n").alias("words"), F.grouping(group).alias("_all")).where("words IS NOT NULL")
    return out.select(F.when(F.col("_all") == 1, overall).otherwise(F.col(group)).alias(group), "edits", "words", rounded(F.col("edits") / F.col("words"), 4).alias("wer"))


def cer(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(reference, hypothesis) / F.greatest(F.length(reference), F.lit(1))


def concatenated(pairs: DataFrame, keys: list[str], idx: str, texts: list[str]) -> DataFrame:
    """Word arrays of the rows with equal ``keys`` as one each, in order, for error rates that align a document once. A group
    is one document's texts in one language, which the alignment needs whole."""
    rows = F.array_sort(F.collect_list(F.struct(idx, *texts)))
    one = lambda c: F.flatten(F.transform("_x", lambda s: s[c])).alias(c)
    return pairs.groupBy(*keys).agg(rows.alias("_x")).select(*keys, *map(one, texts))


def confusion_matrix(df: DataFrame, gold: str, predicted: str, labels: list) -> DataFrame:
    out = df.groupBy(gold).pivot(predicted, labels).count().fillna(0, [str(x) for x in labels])
    return out.select(gold, *(F.col(str(x)).alias(f"pred_{x}") for x in labels))


def prf(df: DataFrame, gold: str, predicted: str, labels: list) -> DataFrame:
    """(label, precision, recall, f1, accuracy, macro_f1) for every label, absent ones with zeros; one pass over the rows."""
    counts = [c for i, x in enumerate(labels) for c in (F.count_if((F.col(gold) == x) & (F.col(predicted) == x)).alias(f"tp{i}"), F.count_if(F.col(predicted) == x).alias(f"pp{i}"), F.count_if(F.col(gold) == x).alias(f"ap{i}"))]
    one = df.agg(*counts, F.avg((F.col(gold) == F.col(predicted)).cast("double")).alias("accuracy"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = []
    for i, x in enumerate(labels):
        p, r = ratio(F.col(f"tp{i}"), F.col(f"pp{i}")), ratio(F.col(f"tp{i}"), F.col(f"ap{i}"))
        rows.append(F.struct(F.lit(x).alias("label"), p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")))
    all_rows = one.select("accuracy", F.array(*rows).alias("r")).withColumn("macro_f1", F.aggregate("r", F.lit(0.0), lambda a, x: a + x["f1"]) / len(labels))
    return all_rows.select(F.explode("r").alias("r"), "accuracy", "macro_f1").select("r.*", "accuracy", "macro_f1")


def roc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(score, fpr, tpr) per distinct score, highest first: rows are counted per score before anything is ordered."""
    by = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(F.when(F.col(truth) == 1, 1).otherwise(0)).alias("p"), F.count("*").alias("n"))
    c = running_sums(by, "score", ["p", "n"], descending=True)
    all_ = c.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    tp, k = F.col("p_before") + F.col("p"), F.col("n_before") + F.col("n")
    c = c.join(F.broadcast(all_))  # one row
    return c.select("score", ((k - tp) / F.nullif(F.col("all_n") - F.col("all_p"), F.lit(0))).alias("fpr"), (tp / F.nullif(F.col("all_p"), F.lit(0))).alias("tpr"))


def rates_meet(curve: DataFrame) -> DataFrame:
    """One row from ``roc``: ``eer``, the root of 1 - x - TPR(x) on the interpolated curve, 0.5 with one class only; and ``det_eer``, the mean of
    both error rates where they are closest, at the highest score of equals. The curve is read once."""
    past = F.col("fpr") + F.col("tpr") >= 1
    fnr = 1 - F.col("tpr")
    at = curve.agg(
        F.min_by(F.struct("fpr", "tpr"), F.when(past, -F.col("score"))).alias("b"),
        F.max_by(F.struct("fpr", "tpr"), F.when(~past, -F.col("score"))).alias("a"),
        F.min_by((F.col("fpr") + fnr) / 2, F.struct(F.abs(F.col("fpr") - fnr), -F.col("score"))).alias("det_eer"),
    )
    f0, t0 = F.coalesce("a.fpr", F.lit(0.0)), F.coalesce("a.tpr", F.lit(0.0))
    f1, t1 = F.col("b.fpr"), F.col("b.tpr")
    # where the segment from (f0, t0) to (f1, t1) meets fpr + tpr = 1
    share = (1 - f0 - t0) / F.nullif(f1 + t1 - f0 - t0, F.lit(0.0))
    return at.select(F.coalesce(f0 + share * (f1 - f0), F.lit(0.5)).alias("eer"), "det_eer")


def eer(df: DataFrame, truth: str, score: str) -> DataFrame:
    return rates_meet(roc(df, truth, score)).select("eer")


def det_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    return roc(df, truth, score).select("score", "fpr", (1 - F.col("tpr")).alias("fnr"))


def min_flip(df: DataFrame, group: str, epsilon: str, snr: str, flipped: Column, least_snr: float = 40.0) -> DataFrame:
    """The smallest epsilon that flips, and the ratio there: of equal ones the smallest."""
    f = df.where(flipped)
    first = F.when(F.col(epsilon).isNotNull(), F.struct(epsilon, snr))
    return f.groupBy(group).agg(F.min(epsilon).alias("min_epsilon"), F.min_by(snr, first).alias("snr_at_min")).withColumn("meets_snr", F.col("snr_at_min") >= least_snr)


def best_epoch(df: DataFrame, group: str, epoch: str, metric: str, largest: bool = True) -> DataFrame:
    """The first epoch with the best metric."""
    best = (F.max_by if largest else F.min_by)(epoch, F.struct(F.col(metric), -F.col(epoch) if largest else F.col(epoch)))
    return df.groupBy(group).agg(best.alias("epoch"), (F.max if largest else F.min)(metric).alias("best"))


def metric_gates(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """metrics: (metric, value); thresholds: (metric, threshold, largest). Adds pass, null without a threshold."""
    rows = metrics.join(thresholds, "metric", "left")
    ok = F.when(F.col("largest"), F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return rows.withColumn("pass", F.when(F.col("threshold").isNotNull(), ok)).drop("largest")


def coverage(df: DataFrame, group: str, filled: Column, least: float = 0.8) -> DataFrame:
    share = F.count_if(filled) / F.greatest(F.count("*"), F.lit(1))
    return df.groupBy(group).agg(F.count("*").alias("total"), F.count_if(filled).alias("filled"), rounded(share, 3).alias("coverage"), (share >= least).alias("pass"))


def dictionary_size(lines: DataFrame, group: str, line: str, order: str, least: int = 500) -> DataFrame:
    """(group, entries, pass): entries of each dictionary are its lines that are neither blank nor comments, without a header. The
    first of them, by ``order``, is a header if it has tabs and all its cells are letters (spaces and ``_`` aside)."""
    ok = F.col(line).rlike(r"\S") & ~F.startswith(F.col(line), F.lit("#"))
    first = F.min_by(F.regexp_replace(F.col(line), r"^[ \t\r\n]+|[ \t\r\n]+$", ""), F.when(ok, F.col(order)))
    counts = lines.groupBy(group).agg(F.count_if(ok).alias("_n"), F.min_by(line, F.when(ok, F.col(order))).alias("_raw"), first.alias("_first"))
    cell = lambda c: F.regexp_replace(c, "[_ ]", "").rlike(r"^\p{L}+$")
    header = F.contains("_raw", F.lit("\t")) & F.forall(F.split("_first", "\t"), cell)
    return counts.select(group, (F.col("_n") - F.coalesce(header.cast("int"), F.lit(0))).alias("entries")).withColumn("pass", F.col("entries") >= least)


def required_inventory(required: DataFrame, existing: DataFrame, key: str, group: str) -> DataFrame:
    """(group, n_required, n_missing, complete)."""
    e = existing.select(key).distinct().withColumn("_there", F.lit(True))
    r = required.join(e, key, "left")
    return r.groupBy(group).agg(F.count("*").alias("n_required"), F.count_if(F.col("_there").isNull()).alias("n_missing"), F.every(F.col("_there").isNotNull()).alias("complete"))
