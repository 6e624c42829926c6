"""Queries on signals: an embedding is a clip of 64 samples or one frame, and neighbouring embeddings are the frames of a clip."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numbers
from ..operators import segments
from ..operators import signal as op
from .registry import query
from .segments import _S, CLIP, spine, vectors

_X = "list_transform(embedding, lambda x: x::DOUBLE)"
_SUM2 = "list_sum(list_transform({}, lambda x: x * x))"


def rounded(column, digits=6):
    return F.transform(column, lambda v: numbers.rounded(v, digits))


@query(
    f"""WITH n AS (SELECT vec_id, {_X} AS x, list_transform(list_zip({_X}, lead({_X}) OVER (ORDER BY vec_id)), lambda p: p[1] - p[2]) AS d FROM embeddings)
SELECT vec_id, CASE WHEN {_SUM2.format('d')} < 1e-20 THEN 'infinity'::DOUBLE ELSE round(10 * log10({_SUM2.format('x')} / {_SUM2.format('d')}), 4) END AS snr_db FROM n WHERE d[1] IS NOT NULL"""
)
def agg_snr(t):
    """Noise is the difference from the next vector by id."""
    e = t("embeddings").select("vec_id", "embedding")
    later = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    d = e.join(later, "vec_id").select("vec_id", op.energy(F.col("embedding")).alias("s"), op.energy(F.zip_with("embedding", "other", lambda a, b: a.cast("double") - b.cast("double"))).alias("n"))
    return d.select("vec_id", numbers.rounded(op.snr_db(F.col("s"), F.col("n")), 4).alias("snr_db"))


_STATS = """WITH p AS (SELECT vec_id, list_sort(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS p FROM embeddings),
st AS (SELECT vec_id, len(p) / 16 AS duration, sqrt(list_sum(p) / len(p)) AS rms, list_sum(p[1:6]) / 6 AS noise, 10 * log10((list_sum(p[33:64]) / 32) / (list_sum(p[1:6]) / 6)) AS snr FROM p)"""


def stats(t):
    return op.clip_stats(t("embeddings").select("vec_id", "embedding"), "embedding", F.lit(16))


@query(_STATS + " SELECT vec_id, duration, round(rms, 6) AS rms, round(noise, 8) AS noise, round(snr, 4) AS snr FROM st")
def agg_clip_stats(t):
    return stats(t).select("vec_id", "duration", numbers.rounded("rms", 6).alias("rms"), numbers.rounded("noise", 8).alias("noise"), numbers.rounded("snr", 4).alias("snr"))


@query(_STATS + " SELECT vec_id FROM st WHERE duration BETWEEN 2 AND 15 AND rms >= 1e-6 AND (noise = 0 OR snr >= 20)")
def filter_clip_quality(t):
    return op.good_clips(stats(t), least_snr=20.0).select("vec_id")


@query(f"SELECT vec_id, list_transform({_X}, lambda v: round(v * 0.95 / list_max(list_transform(embedding, lambda y: abs(y::DOUBLE))), 6)) AS x FROM embeddings")
def fn_peak_normalize(t):
    return t("embeddings").select("vec_id", rounded(op.peak_normalize(F.col("embedding"))).alias("x"))


@query(f"SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda p: round((p[1]::DOUBLE + p[2]::DOUBLE) / 2, 6)) AS x FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0")
def fn_to_mono(t):
    e = t("embeddings").select("vec_id", "embedding")
    return e.where("vec_id % 2 = 0").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", rounded(op.to_mono(F.col("embedding"), F.col("other"))).alias("x"))


@query(
    """SELECT vec_id, list_transform(range(0, 25), lambda i: round(embedding[floor(i * 63 / 24)::INT + 1]::DOUBLE + (coalesce(embedding[floor(i * 63 / 24)::INT + 2], embedding[floor(i * 63 / 24)::INT + 1])::DOUBLE - embedding[floor(i * 63 / 24)::INT + 1]::DOUBLE) * (i * 63 / 24 - floor(i * 63 / 24)), 6)) AS x FROM embeddings"""
)
def fn_interp_resample(t):
    return t("embeddings").select("vec_id", rounded(op.resample(F.col("embedding"), 25)).alias("x"))


@query("SELECT event_id, round(least(greatest(pow(10, (value - avg(value) OVER (PARTITION BY user_id)) / 20), 0.25), 4), 5) AS gain FROM events")
def fn_energy_gain(t):
    mean = t("events").groupBy("user_id").agg(F.avg("value").alias("m"))
    return t("events").join(mean, "user_id").select("event_id", numbers.rounded(op.energy_gain(F.col("value"), F.col("m")), 5).alias("gain"))


@query(
    """WITH m AS (SELECT user_id, coalesce(median(value) FILTER (WHERE event_type = 'view'), 200) AS own, coalesce(median(value) FILTER (WHERE event_type = 'purchase'), 200) AS target FROM events WHERE value > 0 GROUP BY user_id)
SELECT user_id, round(greatest(least(12 * log2(target / own), 12), -12), 5) AS shift FROM m"""
)
def fn_semitone_shift(t):
    of = lambda kind: F.coalesce(F.median(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(200.0))
    m = t("events").where("value > 0").groupBy("user_id").agg(of("view").alias("own"), of("purchase").alias("target"))
    return m.select("user_id", numbers.rounded(op.semitone_shift(F.col("target"), F.col("own")), 5).alias("shift"))


@query("SELECT vec_id, i::INT AS frame_idx, round(sqrt(list_sum(list_transform(embedding[i * 8 + 1:i * 8 + 16], lambda x: x::DOUBLE * x::DOUBLE)) / 16), 6) AS rms FROM (SELECT vec_id, embedding, unnest(range(0, 7)) AS i FROM embeddings)")
def job_frame_energy(t):
    return op.frame_energy(t("embeddings"), "vec_id", "embedding", 16, 8).select("vec_id", "frame_idx", numbers.rounded("rms", 6).alias("rms"))


_FR = f"WITH fr AS (SELECT vec_id // {CLIP} AS clip, row_number() OVER (PARTITION BY vec_id // {CLIP} ORDER BY vec_id) - 1 AS frame_idx, embedding AS v FROM embeddings)"
_POWER = (
    _FR
    + """, w AS (SELECT clip, frame_idx, list_transform(range(0, 64), lambda i: v[i + 1]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * i / 64))) AS x FROM fr),
sp AS (SELECT clip, frame_idx, list_transform(range(0, 33), lambda k: pow(list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * cos(2 * pi() * k * i / 64))), 2) + pow(list_sum(list_transform(range(0, 64), lambda i: x[i + 1] * sin(2 * pi() * k * i / 64))), 2)) AS power FROM w)"""
)


def frames(t):
    return vectors(t).select(F.col("doc").alias("clip"), "frame_idx", F.col("embedding").alias("vec"))


def spectra(t):
    return op.power_spectrum(frames(t), 64)


@query(_POWER + " SELECT clip, frame_idx, list_transform(power, lambda p: round(p, 6)) AS power FROM sp")
def job_power_spectrum(t):
    return spectra(t).select("clip", "frame_idx", rounded("power").alias("power"))


def _matrix_sql(rows):
    return "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in r) + "]" for r in rows) + "]::DOUBLE[][]"


def _apply_sql(x, matrix):
    return f"list_transform({_matrix_sql(matrix)}, lambda r: list_sum(list_transform(list_zip({x}, r), lambda p: p[1] * p[2])))"


# clips of one embedding: 16 samples a second, frames of 16 with a hop of 4, so 4 frames a second and 13 of them; some have null
# samples, some a sample that is no number, and some are too short for a delta
RATE, SIZE, HOP = 16, 16, 4
_CLIPS = f"""WITH clips AS (SELECT vec_id AS clip, CASE vec_id % 40 WHEN 7 THEN NULL WHEN 11 THEN list_concat({_X}[1:63], ['nan'::DOUBLE]) WHEN 19 THEN {_X}[1:40] WHEN 23 THEN {_X}[1:9] ELSE {_X} END AS x FROM embeddings),
fr AS (SELECT clip, i AS frame_idx, list_transform(range(0, 16), lambda j: x[4 * i + j + 1] * (0.5 - 0.5 * cos(2 * pi() * j / 16))) AS v
  FROM (SELECT clip, x, unnest(range(0, (len(x) - 16) // 4 + 1)) AS i FROM clips WHERE NOT isnan(x[len(x)]) AND len(x) >= 16)),
sp AS (SELECT clip, frame_idx, list_transform(range(0, 9), lambda k: pow(list_sum(list_transform(range(0, 16), lambda j: v[j + 1] * cos(2 * pi() * k * j / 16))), 2) + pow(list_sum(list_transform(range(0, 16), lambda j: v[j + 1] * sin(2 * pi() * k * j / 16))), 2)) AS power FROM fr)"""


def clips(t):
    x, k = F.col("embedding").cast("array<double>"), F.col("vec_id") % 40
    nan = F.concat(F.slice(x, 1, 63), F.array(F.lit(float("nan"))))
    samples = F.when(k == 7, None).when(k == 11, nan).when(k == 19, F.slice(x, 1, 40)).when(k == 23, F.slice(x, 1, 9)).otherwise(x)
    return t("embeddings").select(F.col("vec_id").alias("clip"), samples.alias("x"))


_MEL = _CLIPS + f""", b AS (SELECT clip, frame_idx, list_transform({_apply_sql('power', op.mel_filters(6, 9, 16.0))}, lambda v: 10 * log10(greatest(v, 1e-10))) AS b FROM sp), m AS (SELECT clip, max(list_max(b)) AS top FROM b GROUP BY clip),
mel AS (SELECT clip, frame_idx, list_transform(b, lambda v: round(greatest(v - top, -80), 5)) AS vec FROM b JOIN m USING (clip)),
lb AS (SELECT clip, j AS frame_idx, CASE WHEN x[floor(j * 16 / 3)::INT + 1] >= 0 THEN 'up' ELSE 'down' END AS label FROM (SELECT clip, x, unnest(range(0, len(x) * 3 // 16)) AS j FROM clips)),
own AS (SELECT mel.*, lb.label FROM mel JOIN lb USING (clip, frame_idx)), timed AS (SELECT mel.*, lb.label FROM mel JOIN lb ON lb.clip = mel.clip AND lb.frame_idx = mel.frame_idx * 3 // 4)"""


def mel_frames(t):
    """Frames four times a second, and labels three times a second: the sign of the sample at the label's time."""
    c = clips(t)
    mel = op.feature_frames(op.clip_features(c, "clip", "x", op.logmel(SIZE, HOP, 6, 16.0)))
    n = F.floor(F.size("x") * 3 / RATE).cast("int")
    labels = c.where("size(x) * 3 >= 16").select("clip", "x", F.explode(F.sequence(F.lit(0), n - 1)).alias("frame_idx"))
    sign = F.when(F.get("x", F.floor(F.col("frame_idx") * RATE / 3).cast("int")) >= 0, "up").otherwise("down")
    return mel, labels.select("clip", "frame_idx", sign.alias("label"))


@query(
    _MEL
    + """ SELECT a.clip, a.frame_idx::INT AS frame_idx, a.vec, b.label AS same_number, a.label AS same_time, m.n_frames, m.n_labels, m.n_kept, m.duration
FROM timed a LEFT JOIN own b USING (clip, frame_idx) JOIN (
  SELECT clip, f.n AS n_frames, coalesce(l.n, 0) AS n_labels, coalesce(k.n, 0) AS n_kept, round(coalesce(k.n, 0) / 4, 3) AS duration FROM (SELECT clip, count(*) AS n FROM mel GROUP BY clip) f
  LEFT JOIN (SELECT clip, count(*) AS n FROM lb GROUP BY clip) l USING (clip) LEFT JOIN (SELECT clip, count(*) AS n FROM timed GROUP BY clip) k USING (clip)) m USING (clip)"""
)
def job_logmel(t):
    """Frames with the label of their number (the shorter of both sides) and that of their time, and the clip's lengths."""
    mel, labels = mel_frames(t)
    timed = op.label_frames(mel, labels, (RATE // HOP, 3))
    own = op.label_frames(mel, labels).select("clip", "frame_idx", F.col("label").alias("same_number"))
    out = timed.withColumnRenamed("label", "same_time").join(own, ["clip", "frame_idx"], "left").join(op.label_manifest(mel, labels, timed, RATE / HOP), "clip")
    return out.withColumn("vec", rounded("vec", 5))


_LFCC = (
    _CLIPS
    + f""", b AS (SELECT clip, frame_idx, list_transform({_apply_sql('power', op.linear_filters(8, 9))}, lambda v: ln(v + 1e-8)) AS b FROM sp), c AS (SELECT clip, frame_idx, {_apply_sql('b', op.dct_matrix(4, 8))} AS c FROM b),
w AS (SELECT clip, array_agg(c ORDER BY frame_idx) AS s FROM c GROUP BY clip HAVING count(*) >= 9)"""
)
_DELTA_SQL = "list_transform(range(0, len({0})), lambda t: list_transform(range(1, 5), lambda k: list_sum(list_transform(range(-4, 5), lambda n: n * {0}[greatest(4, least(t, len({0}) - 5)) + n + 1][k])) / 60))"


@query(
    _LFCC
    + f""", d AS (SELECT clip, s, {_DELTA_SQL.format('s')} AS d FROM w), dd AS (SELECT clip, s, d, {_DELTA_SQL.format('d')} AS dd FROM d)
SELECT clip, i::INT AS frame_idx, list_transform(list_concat(s[i + 1], d[i + 1], dd[i + 1]), lambda v: round(v, 5)) AS vec, NULL AS reason FROM (SELECT *, unnest(range(0, len(s))) AS i FROM dd)
UNION ALL SELECT clip, NULL, NULL, CASE WHEN x IS NULL THEN 'no samples' WHEN isnan(x[len(x)]) THEN 'not a finite number' WHEN len(x) < 16 THEN 'shorter than a frame' ELSE 'fewer than 9 frames' END FROM clips WHERE clip NOT IN (SELECT clip FROM w)"""
)
def job_lfcc(t):
    """Coefficients with first and second deltas, and the clips that have none with the reason."""
    features = op.clip_features(clips(t), "clip", "x", op.lfcc(SIZE, HOP, 4, deltas=2))
    frames = op.feature_frames(features).select("clip", "frame_idx", rounded("vec", 5).alias("vec"), F.lit(None).cast("string").alias("reason"))
    return frames.unionByName(op.quarantined(features), allowMissingColumns=True)


@query(
    _POWER
    + """, u AS (SELECT clip, frame_idx, unnest(range(0, 33)) AS bin, power FROM sp), z AS (SELECT clip, frame_idx, bin, power[bin + 1] AS p FROM u), nz AS (SELECT clip, bin, avg(sqrt(p)) AS n FROM z WHERE frame_idx < 10 GROUP BY clip, bin)
SELECT clip, frame_idx, bin::INT AS bin, round(greatest(p - 2 * n * n, pow(0.01 * n, 2)), 6) AS power FROM z JOIN nz USING (clip, bin)"""
)
def job_denoise(t):
    return op.spectral_subtraction(spectra(t)).select("clip", "frame_idx", "bin", numbers.rounded("power", 6).alias("power"))


_PAIR = _FR + ", pr AS (SELECT a.clip // 2 AS pair, a.frame_idx, a.v AS va, b.v AS vb FROM fr a JOIN fr b ON b.clip = a.clip + 1 AND a.clip % 2 = 0 AND b.frame_idx = a.frame_idx)"


def clip_pairs(t):
    v = vectors(t).select(F.floor(F.col("doc") / 2).alias("pair"), "frame_idx", F.col("embedding").alias("vec"), "doc")
    return op.join_frames(v.where("doc % 2 = 0"), v.where("doc % 2 = 1"))


@query(_PAIR + " SELECT pair, frame_idx, va[1] AS a, vb[1] AS b FROM pr")
def join_frames(t):
    return clip_pairs(t).select("pair", "frame_idx", F.get("vec_a", F.lit(0)).alias("a"), F.get("vec_b", F.lit(0)).alias("b"))


@query(_PAIR + " SELECT pair, round(10 * sqrt(2) / ln(10) * avg(sqrt(list_sum(list_transform(list_zip(va, vb), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2))))), 4) AS mcd FROM pr GROUP BY pair")
def agg_mcd(t):
    return op.mcd(clip_pairs(t)).select("pair", numbers.rounded("mcd", 4).alias("mcd"))


@query("SELECT vec_id, round(abs(embedding[1]::DOUBLE) * 4, 5) AS p_en, round(abs(embedding[2]::DOUBLE) * 4, 5) AS p_hi, CASE WHEN abs(embedding[1]) > abs(embedding[2]) THEN 'en' ELSE 'hi' END AS language FROM embeddings WHERE greatest(abs(embedding[1]), abs(embedding[2])) * 4 >= 0.6")
def filter_confident_language(t):
    p = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double"))
    rows = t("embeddings").select("vec_id", p(0).alias("a"), p(1).alias("b")).where(F.greatest("a", "b") * 4 >= 0.6)
    return rows.select("vec_id", numbers.rounded(F.col("a") * 4, 5).alias("p_en"), numbers.rounded(F.col("b") * 4, 5).alias("p_hi"), F.when(F.col("a") > F.col("b"), "en").otherwise("hi").alias("language"))


@query(_STATS + f", q AS (SELECT vec_id, duration FROM st WHERE rms >= 1e-6 AND (noise = 0 OR snr >= 15)) SELECT vec_id, label, duration, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS peak FROM q JOIN embeddings USING (vec_id)")
def job_curate_tts(t):
    """Good clips, normalised, as a manifest."""
    good = op.good_clips(op.clip_stats(t("embeddings").select("vec_id", "label", "embedding"), "embedding", F.lit(16)))
    level = good.withColumn("x", op.peak_normalize(F.col("embedding")))
    return level.select("vec_id", "label", "duration", numbers.rounded(F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double")))), 6).alias("peak"))


def contours(t):
    """The values of each user; neighbouring users are pairs."""
    s = spine(t).select(F.floor(F.col("doc") / 2).alias("pair"), F.col("seg_idx").alias("frame_idx"), "value", (F.col("doc") % 2).alias("side"))
    return s.where("side = 0").drop("side"), s.where("side = 1").drop("side")


def _aligned_sql(rows):
    """Dynamic time warping in SQL, from rows (pair, side, frame_idx, value): the totals of an antidiagonal are a list, made from
    the two lists before it; then each pair goes back from its end."""
    return f"""WITH RECURSIVE fr AS ({rows}), n AS (SELECT pair, count(*) FILTER (side = 0) AS n, count(*) FILTER (side = 1) AS m FROM fr GROUP BY pair HAVING n > 0 AND m > 0),
k AS (SELECT pair, greatest(1, greatest(n, m) // 5000) AS k FROM n),
l AS (SELECT pair, any_value(k) AS k, array_agg(value ORDER BY frame_idx) FILTER (side = 0) AS x, array_agg(value ORDER BY frame_idx) FILTER (side = 1) AS y FROM fr JOIN k USING (pair) WHERE frame_idx % k = 0 GROUP BY pair),
z AS (SELECT *, len(x) AS nx, len(y) AS ny, greatest(floor(0.25::DOUBLE * greatest(len(x), len(y)))::INT, abs(len(x) - len(y)) + 1) AS w FROM l),
t AS (
  SELECT pair, 1 AS s, list_transform(range(0, nx + 1), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE 'infinity'::DOUBLE END) AS o, list_transform(range(0, nx + 1), lambda i: 'infinity'::DOUBLE) AS c FROM z
  UNION ALL SELECT t.pair, s + 1, c, list_transform(range(0, nx + 1), lambda i: CASE WHEN i >= 1 AND s + 1 - i BETWEEN 1 AND ny AND abs(2 * i - s - 1) <= w THEN pow(x[i] - y[s + 1 - i], 2) + least(o[i], c[i], c[i + 1]) ELSE 'infinity'::DOUBLE END)
  FROM t JOIN z USING (pair) WHERE s < nx + ny),
b AS (
  SELECT pair, 1 AS step, nx AS i, ny AS j FROM z
  UNION ALL SELECT b.pair, step + 1, CASE WHEN o[i] <= least(c[i], c[i + 1]) OR c[i] <= c[i + 1] THEN i - 1 ELSE i END, CASE WHEN o[i] <= least(c[i], c[i + 1]) OR c[i + 1] < c[i] THEN j - 1 ELSE j END
  FROM b JOIN t ON t.pair = b.pair AND t.s = i + j - 1 WHERE i > 0 AND j > 0),
path AS (SELECT pair, (row_number() OVER (PARTITION BY pair ORDER BY step DESC) - 1)::INT AS path_ord, ((i - 1) * k)::INT AS src_idx, ((j - 1) * k)::INT AS tgt_idx FROM b JOIN k USING (pair) WHERE i > 0 AND j > 0)"""


_CONTOURS = _S + " SELECT doc // 2 AS pair, doc % 2 AS side, seg_idx AS frame_idx, value FROM spine"
_ALIGNED = _aligned_sql(_CONTOURS)


@query(_ALIGNED + " SELECT pair, path_ord, src_idx, tgt_idx FROM path")
def job_align_series(t):
    """Dynamic time warping of the values of neighbouring users."""
    return op.align(*segments.stride_pair(*contours(t)))


@query(
    _ALIGNED
    + """, last AS (SELECT pair, src_idx, arg_max(tgt_idx, path_ord) AS tgt_idx FROM path GROUP BY pair, src_idx)
SELECT a.pair, a.frame_idx, coalesce(b.value, a.value) AS value FROM fr a LEFT JOIN last ON last.pair = a.pair AND last.src_idx = a.frame_idx LEFT JOIN fr b ON b.pair = a.pair AND b.side = 1 AND b.frame_idx = last.tgt_idx WHERE a.side = 0"""
)
def job_warp_contour(t):
    a, b = contours(t)
    return op.warp(op.align(*segments.stride_pair(a, b)), a, b)


@query(
    _aligned_sql(_FR + " SELECT clip // 2 AS pair, clip % 2 AS side, frame_idx, v[1]::DOUBLE AS value, v FROM fr")
    + """ SELECT path.pair, round(10 * sqrt(2) / ln(10) * avg(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2))))), 4) AS mcd
FROM path JOIN fr a ON a.pair = path.pair AND a.side = 0 AND a.frame_idx = src_idx JOIN fr b ON b.pair = path.pair AND b.side = 1 AND b.frame_idx = tgt_idx GROUP BY path.pair"""
)
def job_mcd_corpus(t):
    """Distortion of aligned pairs of clips, frames matched by their first coefficient."""
    v = vectors(t).select(F.floor(F.col("doc") / 2).alias("pair"), "frame_idx", F.col("x").alias("value"), F.col("embedding").alias("vec"), "doc")
    a, b = segments.stride_pair(v.where("doc % 2 = 0"), v.where("doc % 2 = 1"))
    p = op.align(a, b)
    pairs = p.join(a.select("pair", F.col("frame_idx").alias("src_idx"), F.col("vec").alias("vec_a")), ["pair", "src_idx"]).join(b.select("pair", F.col("frame_idx").alias("tgt_idx"), F.col("vec").alias("vec_b")), ["pair", "tgt_idx"])
    return op.mcd(pairs).select("pair", numbers.rounded("mcd", 4).alias("mcd"))
