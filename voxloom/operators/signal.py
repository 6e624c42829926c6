"""Signals as array columns and frames as rows: levels, spectra, cepstra, distortion and alignment.

Clips have samples in an array; frames are rows (clip, frame_idx, vec). Spectra, filters and cepstra are matrix products in
one Arrow kernel over batches of frames, and the alignment recurrence is one over a pair; the rest are built-in functions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numbers import rounded

MCD = 10 * math.sqrt(2) / math.log(10)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _square(x: Column) -> Column:
    return F.transform(x, lambda v: v.cast("double") * v.cast("double"))


def energy(x: Column) -> Column:
    return _sum(_square(x))


def snr_db(signal: Column, noise: Column) -> Column:
    """Of two sums of squares; infinite without noise."""
    return F.when(noise < 1e-20, float("inf")).otherwise(10 * F.log10(signal / noise))


def clip_stats(df: DataFrame, samples: str, rate: Column) -> DataFrame:
    """Adds duration, rms, noise and snr: noise is the mean of the lowest tenth of the powers, signal that of the upper half."""
    n = F.size(samples)
    power = F.array_sort(_square(F.col(samples)))
    rows = df.withColumn("_p", power).withColumn("duration", n / rate).withColumn("rms", F.sqrt(_sum(F.col("_p")) / F.greatest(n, F.lit(1))))
    tenth, half = F.floor(n / 10).cast("int"), F.floor(n / 2).cast("int")
    noise = F.when(tenth > 0, _sum(F.slice("_p", F.lit(1), tenth)) / tenth).otherwise(0.0)
    signal = _sum(F.slice("_p", half + 1, n - half)) / F.greatest(n - half, F.lit(1))
    out = rows.withColumn("noise", noise).withColumn("_s", signal)
    return out.withColumn("snr", F.when(F.col("noise") > 0, 10 * F.log10(F.col("_s") / F.col("noise")))).drop("_p", "_s")


def good_clips(stats: DataFrame, shortest: float = 2.0, longest: float = 15.0, least_rms: float = 1e-6, least_snr: float = 15.0) -> DataFrame:
    return stats.where(F.col("duration").between(shortest, longest) & (F.col("rms") >= least_rms) & ((F.col("noise") == 0) | (F.col("snr") >= least_snr)))


def peak_normalize(x: Column, peak: float = 0.95) -> Column:
    top = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
    return F.when(top > 0, F.transform(x, lambda v: v * peak / top)).otherwise(x.cast("array<double>"))


def to_mono(*channels: Column) -> Column:
    x = F.arrays_zip(*(c.alias(f"c{i}") for i, c in enumerate(channels))) if len(channels) > 2 else None
    if x is None:
        return F.zip_with(channels[0], channels[1], lambda a, b: (a.cast("double") + b.cast("double")) / 2)
    return F.transform(x, lambda s: sum(s[f"c{i}"].cast("double") for i in range(len(channels))) / len(channels))


def resample(x: Column, n: int) -> Column:
    """Linear interpolation at n points; NaN counts as 0."""
    clean = F.transform(x, lambda v: F.when(F.isnan(v), 0.0).otherwise(v.cast("double")))

    def at(i):
        p = i * (F.size(x) - 1) / max(n - 1, 1)
        lo = F.floor(p).cast("int")
        a, b = F.get(clean, lo), F.coalesce(F.get(clean, lo + 1), F.get(clean, lo))
        return a + (b - a) * (p - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def energy_gain(e: Column, mean: Column) -> Column:
    return F.least(F.greatest(F.pow(F.lit(10.0), (e - mean) / 20), F.lit(0.25)), F.lit(4.0))


def semitone_shift(target: Column, own: Column) -> Column:
    return F.greatest(F.least(12 * F.log2(target / own), F.lit(12.0)), F.lit(-12.0))


def frame_energy(df: DataFrame, clip: str, samples: str, size: int, hop: int) -> DataFrame:
    """(clip, frame_idx, rms) of full frames."""
    n = F.size(samples)
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return df.select(clip, samples, F.posexplode(starts).alias("frame_idx", "_s")).select(clip, "frame_idx", F.sqrt(energy(F.slice(samples, F.col("_s") + 1, F.lit(size))) / size).alias("rms"))


def frames_of(df: DataFrame, clip: str, samples: str, size: int, hop: int) -> DataFrame:
    n = F.size(samples)
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(hop))).otherwise(F.array().cast("array<int>"))
    return df.select(clip, samples, F.posexplode(starts).alias("frame_idx", "_s")).select(F.col(clip).alias("clip"), "frame_idx", F.slice(samples, F.col("_s") + 1, F.lit(size)).alias("vec"))


def by_frame(frames: DataFrame, size: int, kernel, name: str = "vec") -> DataFrame:
    """(clip, frame_idx, name): ``kernel`` maps a matrix of frames of ``size`` samples, a batch at a time; frames of another
    size, or with nulls, are left out."""
    schema = f"clip {frames.schema['clip'].dataType.simpleString()}, frame_idx {frames.schema['frame_idx'].dataType.simpleString()}, {name} array<double>"

    def run(batches):
        for batch in batches:
            if len(batch):
                out = kernel(np.asarray(batch.column(2).flatten(), np.float64).reshape(-1, size))
                ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["clip", "frame_idx", name])

    whole = frames.where((F.size("vec") == size) & F.forall("vec", lambda v: v.isNotNull()))
    return whole.select("clip", "frame_idx", F.col("vec").cast("array<double>")).mapInArrow(run, schema)


def spectrum(size: int):
    """Powers of Hann-windowed frames, size // 2 + 1 bins."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    return lambda x: np.abs(np.fft.rfft(x * window, axis=1)) ** 2


def power_spectrum(frames: DataFrame, size: int) -> DataFrame:
    """(clip, frame_idx, power)"""
    return by_frame(frames, size, spectrum(size), "power")


def linear_filters(n: int, bins: int) -> list[list[float]]:
    """Triangular filters with edges evenly spread over the bins; the bins of a side rise evenly from 0 to 1, or fall to 0."""
    edges = np.linspace(0, bins - 1, n + 2, dtype=int)
    out = np.zeros((n, bins))
    for row, a, b, c in zip(out, edges, edges[1:], edges[2:]):
        row[a:b], row[b:c] = np.linspace(0, 1, b - a), np.linspace(1, 0, c - b)
    return out.tolist()


def mel_filters(n: int, bins: int, rate: float) -> list[list[float]]:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hertz = 700 * (10 ** (np.linspace(mel(0.0), mel(rate / 2), n + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, bins)
    up = (f[None] - hertz[:-2, None]) / np.diff(hertz)[:-1, None]
    down = (hertz[2:, None] - f[None]) / np.diff(hertz)[1:, None]
    return np.maximum(0, np.minimum(up, down)).tolist()


def dct_matrix(n: int, size: int) -> list[list[float]]:
    """Orthonormal DCT-II, the first n rows."""
    return [[math.sqrt((1 if k == 0 else 2) / size) * math.cos(math.pi * k * (2 * i + 1) / (2 * size)) for i in range(size)] for k in range(n)]


class BadClip(ValueError):
    """Why a clip has no features."""


def framed(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """The full frames of one clip."""
    if len(x) < size:
        raise BadClip("shorter than a frame")
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def lfcc(size: int, hop: int, n: int, deltas: int = 0, half: int = 4):
    """Kernel of a clip: logarithms of 2 n linear filters, the first n cosine coefficients, and after these their deltas."""
    power, filters, cosines = spectrum(size), np.array(linear_filters(2 * n, size // 2 + 1)).T, np.array(dct_matrix(n, 2 * n)).T

    def kernel(x: np.ndarray) -> np.ndarray:
        parts = [np.log(power(framed(x, size, hop)) @ filters + 1e-8) @ cosines]
        for _ in range(deltas):
            parts.append(slopes(parts[-1], half))
        return np.concatenate(parts, axis=1)

    return kernel


def slopes(x: np.ndarray, half: int = 4) -> np.ndarray:
    """Regression slopes over 2 half + 1 frames; frames at the edges have that of the first or last full window."""
    if len(x) < 2 * half + 1:
        raise BadClip(f"fewer than {2 * half + 1} frames")
    weights = np.arange(-half, half + 1)
    inner = np.lib.stride_tricks.sliding_window_view(x, 2 * half + 1, axis=0) @ (weights / (weights @ weights))
    return np.concatenate((np.repeat(inner[:1], half, 0), inner, np.repeat(inner[-1:], half, 0)))


def logmel(size: int, hop: int, n: int, rate: float, deepest: float = 80.0):
    """Kernel of a clip: decibels of mel filters relative to the loudest value of the clip, at most ``deepest`` below it."""
    power, filters = spectrum(size), np.array(mel_filters(n, size // 2 + 1, rate)).T

    def kernel(x: np.ndarray) -> np.ndarray:
        level = 10 * np.log10(np.maximum(power(framed(x, size, hop)) @ filters, 1e-10))
        return np.maximum(level - level.max(), -deepest)

    return kernel


def clip_features(clips: DataFrame, clip: str, samples: str, kernel) -> DataFrame:
    """(clip, reason, n_frames, n_coeffs, features): one row for each clip, in one pass and without a shuffle. ``features`` holds a row of
    coefficients for each frame. A clip that can't be used has a ``reason`` and no features, and doesn't disturb the others:
    no samples, samples that are null or no finite numbers, too few of them, or what the kernel fails with."""
    schema = f"clip {clips.schema[clip].dataType.simpleString()}, reason string, n_frames int, n_coeffs int, features array<array<double>>"

    def one(values, valid: bool) -> tuple[str | None, np.ndarray | None]:
        try:
            if values is None or not len(values):
                raise BadClip("no samples")
            if not valid or not np.isfinite(values).all():
                raise BadClip("not a finite number")
            out = kernel(values)
            if not np.isfinite(out).all():
                raise BadClip("features are no finite numbers")
            return None, out
        except BadClip as why:
            return str(why), None
        except Exception as why:  # noqa: BLE001  whatever a clip does to a kernel concerns that clip
            return f"{type(why).__name__}: {why}"[:200], None

    def run(batches):
        for batch in batches:
            x = batch.column(1)
            found = []
            for i in range(len(batch)):
                item = x[i]
                values = item.values if item.is_valid else None
                found.append(one(None if values is None else values.to_numpy(zero_copy_only=False), values is None or values.null_count == 0))
            good = [f for _, f in found if f is not None]
            rows, width = sum(map(len, good)), max((f.shape[1] for f in good), default=0)
            flat = np.concatenate([f.ravel() for f in good]) if good else np.zeros(0)
            inner = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(flat))
            counts = pa.array([None if f is None else len(f) for _, f in found], pa.int32())
            ends = np.concatenate(([0], np.cumsum([0 if f is None else len(f) for _, f in found]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.array([*(f is None for _, f in found), False])), inner)
            coefficients = pa.array([None if f is None else f.shape[1] for _, f in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in found], pa.string()), counts, coefficients, lists], names=["clip", "reason", "n_frames", "n_coeffs", "features"])

    return clips.select(F.col(clip).alias("clip"), F.col(samples).cast("array<double>")).mapInArrow(run, schema)


def quarantined(features: DataFrame) -> DataFrame:
    return features.where("reason IS NOT NULL").select("clip", "reason")


def feature_manifest(features: DataFrame) -> DataFrame:
    """(clip, n_frames, n_coeffs) of the clips that have features."""
    return features.where("reason IS NULL").select("clip", "n_frames", "n_coeffs")


def feature_counts(features: DataFrame) -> DataFrame:
    """One row: n_success, n_fail."""
    return features.agg(F.count_if(F.col("reason").isNull()).alias("n_success"), F.count_if(F.col("reason").isNotNull()).alias("n_fail"))


def feature_frames(features: DataFrame) -> DataFrame:
    """(clip, frame_idx, vec)"""
    return features.where("reason IS NULL").select("clip", F.posexplode("features").alias("frame_idx", "vec"))


def label_frames(frames: DataFrame, labels: DataFrame, rates: tuple[int, int] | None = None) -> DataFrame:
    """(clip, frame_idx, vec, label): the frames of features (clip, frame_idx, vec) with the labels (clip, frame_idx, label) of their own numbers;
    the longer side is cut. With ``rates``, frames and labels a second, frame t takes the label at its time, which
    is label floor(t * labels / frames), and frames behind the last label go."""
    at = F.col("frame_idx") if rates is None else F.expr(f"frame_idx * {rates[1]}L div {rates[0]}L")
    named = labels.select("clip", F.col("frame_idx").cast("long").alias("_at"), "label")
    return frames.withColumn("_at", at.cast("long")).join(named, ["clip", "_at"]).select("clip", "frame_idx", "vec", "label")


def label_manifest(frames: DataFrame, labels: DataFrame, labelled: DataFrame, rate: float) -> DataFrame:
    """(clip, n_frames, n_labels, n_kept, duration): how long features, labels, and what was kept of them are."""
    count = lambda df, name: df.groupBy("clip").agg(F.count("*").alias(name))
    out = count(frames, "n_frames").join(count(labels, "n_labels"), "clip", "full").join(count(labelled, "n_kept"), "clip", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("clip", *map(zero, ("n_frames", "n_labels", "n_kept")), rounded(zero("n_kept") / rate, 3).alias("duration"))


def spectral_subtraction(spectra: DataFrame, noise_frames: int = 10, over: float = 2.0, floor: float = 0.01) -> DataFrame:
    """(clip, frame_idx, bin, power): the mean magnitude of the first frames is taken off, down to a floor."""
    bins = spectra.select("clip", "frame_idx", F.posexplode("power").alias("bin", "_p")).withColumn("_m", F.sqrt("_p"))
    noise = bins.where(F.col("frame_idx") < noise_frames).groupBy("clip", "bin").agg(F.avg("_m").alias("_n"))
    return bins.join(noise, ["clip", "bin"]).select("clip", "frame_idx", "bin", F.greatest(F.col("_p") - over * F.col("_n") * F.col("_n"), F.pow(floor * F.col("_n"), F.lit(2.0))).alias("power"))


def join_frames(a: DataFrame, b: DataFrame, pair: str = "pair") -> DataFrame:
    """Frames with the same number; the longer side is cut."""
    return a.select(pair, "frame_idx", F.col("vec").alias("vec_a")).join(b.select(pair, "frame_idx", F.col("vec").alias("vec_b")), [pair, "frame_idx"])


def mcd(pairs: DataFrame, pair: str = "pair") -> DataFrame:
    distance = F.sqrt(_sum(F.zip_with("vec_a", "vec_b", lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))
    return pairs.groupBy(pair).agg((F.lit(MCD) * F.avg(distance)).alias("mcd"))


def path(x: np.ndarray, y: np.ndarray, band: float = 0.25) -> list[tuple[int, int]]:
    """Dynamic time warping of two arrays of frames in a band around the diagonal: squared cost, 0 where either is NaN; going
    back, the diagonal comes first among equals.

    Cells of one antidiagonal depend on the two before it only, so each is one step of array arithmetic on three rows. Of a cell, only
    where its path came from is kept, in two bits."""
    n, m = len(x), len(y)
    width = max(int(band * max(n, m)), abs(n - m) + 1)
    x, y = x.reshape(n, -1), y.reshape(m, -1)[::-1]
    older, old = np.full(n + 1, np.inf), np.full(n + 1, np.inf)  # totals by i, of the antidiagonals s - 2 and s - 1
    older[0] = 0.0
    came: list[tuple[int, np.ndarray, np.ndarray]] = []
    for s in range(2, n + m + 1):
        lo, hi = max(1, s - m, (s - width + 1) // 2), min(n, s - 1, (s + width) // 2)
        new = np.full(n + 1, np.inf)
        if lo <= hi:
            # j falls as i rises, and y is reversed
            cost = ((x[lo - 1 : hi] - y[m - s + lo : m - s + hi + 1]) ** 2).sum(1)
            cost[np.isnan(cost)] = 0.0
            slant, up, left = older[lo - 1 : hi], old[lo - 1 : hi], old[lo : hi + 1]
            best = np.minimum(np.minimum(slant, up), left)
            new[lo : hi + 1] = cost + best
            straight = slant > best
            came.append((lo, np.packbits(straight), np.packbits(straight & (up > best))))
        else:
            came.append((lo, *[np.zeros(0, np.uint8)] * 2))
        older, old = old, new
    out, i, j = [], n, m
    while i and j:
        out.append((i - 1, j - 1))
        lo, straight, leftward = came[i + j - 2]
        at, bit = divmod(i - lo, 8)
        aside, leftward = (bool(int(bits[at]) >> (7 - bit) & 1) for bits in (straight, leftward))
        i, j = i - (not leftward), j - (leftward or not aside)
    return out[::-1]


def align(a: DataFrame, b: DataFrame, pair: str = "pair", band: float = 0.25) -> DataFrame:
    """(pair, path_ord, src_idx, tgt_idx) for each pair of contours (pair, frame_idx, value); a group is one pair, which ``stride``
    keeps to a bounded number of frames."""
    kind = a.schema[pair].dataType.simpleString()
    schema = f"{pair} {kind}, path_ord int, src_idx int, tgt_idx int"

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("frame_idx"), right.sort_by("frame_idx")
        if not len(left) or not len(right):
            return pa.table({pair: pa.array([], left.schema.field(pair).type), "path_ord": pa.array([], pa.int32()), "src_idx": pa.array([], pa.int32()), "tgt_idx": pa.array([], pa.int32())})
        x, y = (np.array([np.nan if v is None else v for v in t.column("value").to_pylist()], np.float64) for t in (left, right))
        p = path(x, y, band)
        s, t = left.column("frame_idx").to_pylist(), right.column("frame_idx").to_pylist()
        return pa.table({pair: pa.array([key[0].as_py()] * len(p), left.schema.field(pair).type), "path_ord": pa.array(range(len(p)), pa.int32()), "src_idx": pa.array([s[i] for i, _ in p], pa.int32()), "tgt_idx": pa.array([t[j] for _, j in p], pa.int32())})

    # new names for the columns, as both sides may come from one table
    own, other = (x.select(*(F.col(c).alias(c) for c in (pair, "frame_idx", "value"))) for x in (a, b))
    return own.groupBy(pair).cogroup(other.groupBy(pair)).applyInArrow(run, schema)


def warp(alignment: DataFrame, source: DataFrame, target: DataFrame, pair: str = "pair") -> DataFrame:
    """(pair, frame_idx, value): each source frame takes the last target value aligned with it."""
    last = alignment.groupBy(pair, F.col("src_idx").alias("frame_idx")).agg(F.max_by("tgt_idx", "path_ord").alias("tgt_idx"))
    own = last.join(target.select(pair, F.col("frame_idx").alias("tgt_idx"), F.col("value").alias("_v")), [pair, "tgt_idx"], "left").select(pair, "frame_idx", "_v")
    return source.select(pair, "frame_idx", "value").join(own, [pair, "frame_idx"], "left").select(pair, "frame_idx", F.coalesce("_v", "value").alias("value"))
