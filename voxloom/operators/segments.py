"""Runs, switches and intervals on ordered segments of documents; time slicing of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import rounded
from .ordered import nearest_marks, ranged


def _by(doc: str, idx: str):
    return W.partitionBy(doc).orderBy(idx)


def with_run(df: DataFrame, doc: str = "doc", idx: str = "seg_idx", label: str = "language") -> DataFrame:
    """Adds ``run``: the number of the run of equal labels that a row belongs to, from 1."""
    before = F.lag(label).over(_by(doc, idx))
    return df.withColumn("_new", F.when(before.eqNullSafe(F.col(label)), 0).otherwise(1)).withColumn("run", F.sum("_new").over(_by(doc, idx).rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def merge_runs(df: DataFrame, clip_overlap: bool = False) -> DataFrame:
    """(doc, run, language, start_time, end_time, n): consecutive segments of one language; the end is that of the last. With
    ``clip_overlap`` a run ends where the next one begins, if that is earlier."""
    runs = (
        with_run(df)
        .groupBy("doc", "run")
        .agg(F.first("language").alias("language"), F.min_by("start_time", "seg_idx").alias("start_time"), F.max_by("end_time", "seg_idx").alias("end_time"), F.count("*").alias("n"))
    )
    if not clip_overlap:
        return runs
    after = F.lead("start_time").over(_by("doc", "run"))
    return runs.withColumn("end_time", F.least("end_time", after))


def frame_runs(df: DataFrame) -> DataFrame:
    """(doc, run, label, start_frame, end_frame, confidence) of contiguous equal labels; ``confidence`` is the mean."""
    return (
        with_run(df, idx="frame_idx", label="label")
        .groupBy("doc", "run")
        .agg(F.first("label").alias("label"), F.min("frame_idx").alias("start_frame"), (F.max("frame_idx") + 1).alias("end_frame"), F.avg("confidence").alias("confidence"))
    )


def absorb_short(runs: DataFrame, least: int = 25) -> DataFrame:
    """Runs of fewer frames join the one before, the first never does; label and confidence are the head's. Equal
    neighbours that come about are not merged again."""
    order = _by("doc", "run")
    head = F.when((F.col("end_frame") - F.col("start_frame") >= least) | (F.row_number().over(order) == 1), 1).otherwise(0)
    g = runs.withColumn("_head", head).withColumn("seg", F.sum("_head").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return g.groupBy("doc", "seg").agg(
        F.min_by("label", "run").alias("label"), F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.min_by("confidence", "run").alias("confidence")
    )


def switch_points(df: DataFrame) -> DataFrame:
    before = F.lag("language").over(_by("doc", "seg_idx"))
    return df.where("language IS NOT NULL").withColumn("from_language", before).where("from_language <> language").select("doc", "seg_idx", F.col("start_time").alias("time"), "from_language", F.col("language").alias("to_language"))


def code_switch_marks(df: DataFrame, text: str = "ipa") -> DataFrame:
    """Adds code_switch_before; the text before a switch gets the suffix `` |``."""
    order = _by("doc", "seg_idx")
    before, after = F.lag("language").over(order), F.lead("language").over(order)
    return df.withColumn("code_switch_before", F.coalesce(before != F.col("language"), F.lit(False))).withColumn(text, F.when(after != F.col("language"), F.concat(F.col(text), F.lit(" |"))).otherwise(F.col(text)))


def median_smooth(df: DataFrame, label: str = "label", doc: str = "doc", idx: str = "frame_idx", half: int = 2) -> DataFrame:
    """Adds ``smooth``: the median of 2 half + 1 labels, edges repeated."""
    order, whole = _by(doc, idx), W.partitionBy(doc).orderBy(idx).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(label).over(whole), F.last(label).over(whole)
    near = [F.coalesce(F.lag(label, k).over(order), first) for k in range(1, half + 1)] + [F.coalesce(F.lead(label, k).over(order), last) for k in range(1, half + 1)]
    return df.withColumn("smooth", F.get(F.sort_array(F.array(F.col(label), *near)), F.lit(half)))


def delta(df: DataFrame, column: str, doc: str = "doc", idx: str = "frame_idx", half: int = 4, out: str = "delta") -> DataFrame:
    """Adds the regression slope over 2 half + 1 frames; edges take that of the first or last full window."""
    order, whole = _by(doc, idx), W.partitionBy(doc).orderBy(idx).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = sum((k * (F.lead(column, k).over(order) - F.lag(column, k).over(order)) for k in range(1, half + 1)), F.lit(0.0))
    rows = df.withColumn("_slope", total / (2 * sum(k * k for k in range(1, half + 1))))
    edge = F.when(F.row_number().over(order) <= half, F.first("_slope", ignorenulls=True).over(whole)).otherwise(F.last("_slope", ignorenulls=True).over(whole))
    return rows.withColumn(out, F.coalesce("_slope", edge)).drop("_slope")


def with_deltas(df: DataFrame, column: str, doc: str = "doc", idx: str = "frame_idx", half: int = 4, order: int = 2) -> DataFrame:
    """Adds ``features``: the value, its delta, the delta of that, and so on, ``order`` times; null in documents of fewer than 2 half + 1
    frames, which have no full window."""
    names = [column, *(f"_d{k}" for k in range(1, order + 1))]
    rows = df
    for before, name in zip(names, names[1:]):
        rows = delta(rows, before, doc, idx, half, name)
    values = F.array(*(F.col(n).cast("double") for n in names))
    return rows.withColumn("features", F.when(F.forall(values, lambda v: v.isNotNull()), values)).drop(*names[1:])


def stride(df: DataFrame, most: int = 5000, doc: str = "doc", idx: str = "frame_idx") -> DataFrame:
    """Every k-th frame, k = max(1, n // most)."""
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(W.partitionBy(doc)) / most))
    return df.withColumn("stride", k).where(F.col(idx) % F.col("stride") == 0)


def stride_pair(a: DataFrame, b: DataFrame, most: int = 5000, pair: str = "pair", idx: str = "frame_idx") -> tuple[DataFrame, DataFrame]:
    """Every k-th frame of both sides, with one k for a pair: that of its longer side."""
    both = a.select(F.col(pair).alias(pair), F.lit(0).alias("_side")).unionAll(b.select(F.col(pair).alias(pair), F.lit(1).alias("_side")))
    n = both.groupBy(pair, "_side").count()
    k = n.groupBy(pair).agg(F.greatest(F.lit(1), F.floor(F.max("count") / most)).alias("_k"))
    every = lambda x: x.join(k, pair).where(F.col(idx) % F.col("_k") == 0).drop("_k")
    return every(a), every(b)


def split_by_group(df: DataFrame, group: Column, seed: str = "42", shares: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """Adds ``split``, by a hash of the group, so that pieces of one recording stay together; no shuffle."""
    k = F.conv(F.substring(F.md5(F.concat(group.cast("string"), F.lit(seed)).cast("binary")), 1, 6), 16, 10).cast("int") % 1000
    a, b = int(shares[0] * 1000), int(sum(shares) * 1000 + 0.5)
    return df.withColumn("split", F.when(k < a, "train").when(k < b, "valid").otherwise("test"))


def _placed(sizes: DataFrame, shares: tuple[float, float], least: int) -> DataFrame:
    """Adds ``_train`` and ``_valid``, the ranks at which these splits of a class of ``_all`` rows end."""
    part = lambda share: F.greatest(F.floor(F.col("_all") * F.lit(share)), F.lit(least))
    return sizes.withColumn("_train", part(shares[0])).withColumn("_valid", F.col("_train") + part(shares[1]))


def split_exact(df: DataFrame, key: str, shares: tuple[float, float] = (0.8, 0.1), label: str | None = None, least: int = 0, seed: str | None = "42") -> DataFrame:
    """Adds ``split``: of the rows of each class (of all, without ``label``), in the order of a seeded hash of the key, floor(share * n)
    are for training and for validation, ``least`` at least if there are so many, and the rest are for testing.
    Without ``seed`` rows are taken in the order of the key itself. Keys are distinct in a class.

    No class is sorted in one task: rows get their rank within a range of hashes (or a sampled range of keys), and
    the rows of a class in earlier ranges are added to it."""
    name = F.lit(0) if label is None else F.col(label)
    rows = df.withColumn("_class", name)
    if seed is None:
        order, rows = [key], ranged(rows, F.asc(key))
    else:
        order = ["_digest", key]
        digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"))
        rows = rows.withColumn("_digest", digest).withColumn("_range", F.substring("_digest", 1, 3))
    ranges = rows.groupBy("_class", "_range").agg(F.count("*").alias("_n"))  # 4096 rows a class, or one for each range of keys
    whole = W.partitionBy("_class")
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = _placed(ranges.withColumn("_before", before).withColumn("_all", F.sum("_n").over(whole)), shares, least)
    bases = bases.select(F.col("_class").alias("_c"), F.col("_range").alias("_r"), "_before", "_train", "_valid")
    rank = F.row_number().over(W.partitionBy("_class", "_range").orderBy(*order)) + F.col("_before")
    ranked = rows.join(bases, rows["_class"].eqNullSafe(F.col("_c")) & (rows["_range"] == F.col("_r"))).withColumn("_rank", rank)
    split = F.when(F.col("_rank") <= F.col("_train"), "train").when(F.col("_rank") <= F.col("_valid"), "valid").otherwise("test")
    return ranked.select(*df.columns, split.alias("split"))


def timeline(df: DataFrame, duration: str, doc: str = "doc", idx: str = "seg_idx", pause: float = 0.5) -> DataFrame:
    """Adds ``offset``: where each piece begins when pieces of positive length follow each other with a pause."""
    order = _by(doc, idx)
    step = F.when(F.col(duration) > 0, F.col(duration) + pause).otherwise(F.lit(0.0))
    return df.withColumn("offset", F.coalesce(F.sum(step).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))


# --- slices: arrays of (start, end), end exclusive --------------------------------------------------------------


def _windows(starts: Column, end) -> Column:
    return F.transform(starts, lambda s: F.struct(s.alias("start"), end(s).alias("end")))


def _starts(last: Column, hop: int) -> Column:
    return F.when(last >= 0, F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(hop).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def sliding(n: Column, size: int, hop: int) -> Column:
    """Full windows only."""
    return _windows(_starts(n - size, hop), lambda s: s + size)


def sliding_tail(n: Column, size: int, hop: int, least: int) -> Column:
    """Windows that begin before n - least; the tail is cut at n."""
    return _windows(_starts(n - least - 1, hop), lambda s: F.least(s + size, n))


def padded(n: Column, size: int, hop: int, least: int) -> Column:
    """Full windows; without any, one that is padded, if n > least."""
    whole = sliding(n, size, hop)
    one = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(size).cast("bigint").alias("end")))
    return F.when((F.size(whole) == 0) & (n > least), one).otherwise(whole)


def tumbling(n: Column, size: int, least: int) -> Column:
    """Chunks that follow each other; a tail shorter than ``least`` goes."""
    return F.filter(_windows(_starts(n - 1, size), lambda s: F.least(s + size, n)), lambda w: w["end"] - w["start"] >= least)


def middle(n: Column, size: int) -> Column:
    """The start of the centre part of at most ``size``."""
    return F.greatest(F.lit(0), F.floor(n / 2) - size // 2)


def fix_length(x: Column, n: int, pad: Column) -> Column:
    return F.slice(F.concat(x, F.array_repeat(pad, n)), 1, n)


def best_window(df: DataFrame, flag: Column, size: int, hop: int, doc: str = "doc", idx: str = "frame_idx") -> DataFrame:
    """(doc, start, share, n_padded): the window with the largest share of flagged frames, the first of equals. A document
    shorter than the window is one window from 0, with frames without a flag behind its own, ``n_padded`` of them."""
    order = _by(doc, idx).rowsBetween(0, size - 1)
    w = df.select(doc, idx, F.sum(flag.cast("int")).over(order).alias("k"), F.count("*").over(order).alias("n"))
    # the first frame's window is the only one of a short document
    full = w.where(((F.col("n") == size) | (F.col(idx) == 0)) & (F.col(idx) % hop == 0))
    best = full.groupBy(doc).agg(F.max_by(F.struct(F.col(idx).alias("start"), (F.col("k") / size).alias("share"), (size - F.col("n")).alias("n_padded")), F.struct(F.coalesce("k", F.lit(0)), -F.col(idx))).alias("w"))
    return best.select(doc, "w.start", F.coalesce("w.share", F.lit(0.0)).alias("share"), "w.n_padded")


# --- interval and nearest joins ---------------------------------------------------------------------------------


def join_max_overlap(left: DataFrame, right: DataFrame, bucket: float) -> DataFrame:
    """left: (doc, seg_idx, start_time, end_time, language); right: the same. Adds ``label``: that of the right segment with the
    largest positive overlap, the first of equals, else the own one. Both sides meet in time buckets."""
    cut = lambda s, e: F.explode(F.sequence(F.floor(s / bucket), F.floor(e / bucket)))
    a = left.select("doc", "seg_idx", F.col("start_time").alias("s"), F.col("end_time").alias("e"), cut(F.col("start_time"), F.col("end_time")).alias("b"))
    b = right.select("doc", F.col("seg_idx").alias("other"), F.col("language").alias("label"), F.col("start_time").alias("s2"), F.col("end_time").alias("e2"), cut(F.col("start_time"), F.col("end_time")).alias("b"))
    overlap = F.least("e", "e2") - F.greatest("s", "s2")
    # a pair that meets in several buckets gives the same candidate each time, which max_by doesn't mind
    best = a.join(b, ["doc", "b"]).withColumn("o", overlap).where("o > 0").groupBy("doc", "seg_idx").agg(F.max_by("label", F.struct("o", -F.col("other"))).alias("label"))
    return left.join(best, ["doc", "seg_idx"], "left").withColumn("label", F.coalesce("label", "language"))


def join_nearest_midpoint(left: DataFrame, right: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(doc, seg_idx, ref_idx, dist): the right segment with the nearest midpoint within the tolerance, the first of equals."""
    mid = (F.col("start_time") + F.col("end_time")) / 2
    a = left.select("doc", "seg_idx", mid.alias("m")).withColumn("b", F.explode(F.array(*(F.floor(F.col("m") / tolerance) + k for k in (-1, 0, 1)))))
    b = right.select("doc", F.col("seg_idx").alias("ref_idx"), mid.alias("m2")).withColumn("b", F.floor(F.col("m2") / tolerance))
    d = a.join(b, ["doc", "b"]).withColumn("dist", F.abs(F.col("m") - F.col("m2"))).where(F.col("dist") <= tolerance)
    return d.groupBy("doc", "seg_idx").agg(F.min_by(F.struct("ref_idx", "dist"), F.struct("dist", "ref_idx")).alias("r")).select("doc", "seg_idx", "r.*")


def join_nearest_switch(true: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc, time, error_ms): each true switch with the distance of the nearest predicted one; infinite without any. A
    document may have any number of switches."""
    both = true.select("doc", "time", F.lit(True).alias("real")).unionByName(predicted.select("doc", "time", F.lit(False).alias("real")))
    near = nearest_marks(both, "doc", "time", ~F.col("real"))
    gap = F.least(F.col("time") - F.col("before"), F.col("after") - F.col("time"))
    return near.where("real").select("doc", "time", F.coalesce(gap * 1000, F.lit(float("inf"))).alias("error_ms"))


def switch_accuracy(nearest: DataFrame, predicted: DataFrame, within_ms: float = 200.0, share: float = 0.5) -> DataFrame:
    e = nearest.agg(F.count("*").alias("n_true"), rounded(F.avg("error_ms"), 2).alias("mean_error_ms"), rounded(100 * F.avg((F.col("error_ms") <= within_ms).cast("double")), 2).alias("pct_within"))
    p = predicted.agg(F.count("*").alias("n_predicted"))
    return e.join(F.broadcast(p)).withColumn("pass", F.col("pct_within") >= 100 * share)


def frame_labels(segments: DataFrame, spine: DataFrame, fps: float, default: str = "silence") -> DataFrame:
    """spine: (doc, n_frames). (doc, frame_idx, label): later segments overwrite earlier ones."""
    frames = spine.where("n_frames > 0").select("doc", F.explode(F.sequence(F.lit(0), (F.col("n_frames") - 1).cast("int"))).alias("frame_idx"))
    s = segments.select("doc", "seg_idx", "language", (F.col("start_time") * fps).cast("int").alias("f"), (F.col("end_time") * fps).cast("int").alias("t")).where("t > f")
    own = s.select("doc", "seg_idx", "language", F.explode(F.sequence("f", F.col("t") - 1)).alias("frame_idx")).groupBy("doc", "frame_idx").agg(F.max_by("language", "seg_idx").alias("label"))
    return frames.join(own, ["doc", "frame_idx"], "left").withColumn("label", F.coalesce("label", F.lit(default)))


def rollup(df: DataFrame) -> DataFrame:
    return df.groupBy("doc").agg(F.count("*").alias("num_segments"), F.coalesce(F.max("end_time"), F.lit(0.0)).alias("total_duration"), F.count_distinct("language").alias("n_languages"))


def single_language(df: DataFrame, least: float = 60.0) -> DataFrame:
    """(doc, discard): language marks that cover more than ``least`` seconds with one language at most."""
    return df.groupBy("doc").agg(((F.max("end_time") > least) & (F.count_distinct("language") <= 1)).alias("discard"))


def label_fraction(df: DataFrame, label: str, value: str, doc: str = "doc") -> DataFrame:
    return df.groupBy(doc).agg(F.avg((F.col(label) == value).cast("double")).alias("fraction"))


def majority(df: DataFrame, label: str, doc: str = "doc") -> DataFrame:
    return df.groupBy(doc).agg(F.mode(label, True).alias("label"))
