"""Queries on ordered segments: the events of a user are the segments of a document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numbers
from ..functions import text as fn
from ..operators import segments as op
from ..operators.dictionary import tag_terms
from .dictionary import _PAIRS, _TAG
from .registry import query

_S = """WITH spine AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seg_idx, event_type AS language,
  epoch_us(ts) / 1e6 AS start_time, epoch_us(ts) / 1e6 + value AS end_time, value FROM events)"""
_RUNS = _S + """, r0 AS (SELECT *, CASE WHEN lag(language) OVER w IS NOT DISTINCT FROM language THEN 0 ELSE 1 END AS new FROM spine WINDOW w AS (PARTITION BY doc ORDER BY seg_idx)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY seg_idx) AS run FROM r0)"""


def spine(t):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    idx = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return t("events").select(F.col("user_id").alias("doc"), idx.alias("seg_idx"), F.col("event_type").alias("language"), start.alias("start_time"), (start + F.col("value")).alias("end_time"), "value")


def frames(t):
    return spine(t).select("doc", F.col("seg_idx").alias("frame_idx"), F.col("language").alias("label"), F.col("value").alias("confidence"))


@query(_RUNS + " SELECT doc, run::BIGINT AS run, any_value(language) AS language, round(arg_min(start_time, seg_idx), 3) AS start_time, round(arg_max(end_time, seg_idx), 3) AS end_time, count(*) AS n FROM r GROUP BY doc, run")
def win_merge_runs(t):
    return op.merge_runs(spine(t)).withColumns({c: numbers.rounded(c, 3) for c in ("start_time", "end_time")})


_FRAME_RUNS = _RUNS + ", f AS (SELECT doc, run::BIGINT AS run, any_value(language) AS label, min(seg_idx) AS start_frame, max(seg_idx) + 1 AS end_frame, avg(value) AS confidence FROM r GROUP BY doc, run)"


@query(_FRAME_RUNS + " SELECT doc, run, label, start_frame, end_frame, round(confidence, 6) AS confidence FROM f")
def win_frame_runs(t):
    return op.frame_runs(frames(t)).withColumn("confidence", numbers.rounded("confidence", 6))


@query(
    _FRAME_RUNS
    + """, g AS (SELECT *, sum(CASE WHEN end_frame - start_frame >= 2 OR run = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY run) AS seg FROM f)
SELECT doc, seg::BIGINT AS seg, arg_min(label, run) AS label, min(start_frame) AS start_frame, max(end_frame) AS end_frame, round(arg_min(confidence, run), 6) AS confidence FROM g GROUP BY doc, seg"""
)
def win_absorb_short(t):
    return op.absorb_short(op.frame_runs(frames(t)), 2).withColumn("confidence", numbers.rounded("confidence", 6))


_SWITCH = _S + ", b AS (SELECT *, lag(language) OVER (PARTITION BY doc ORDER BY seg_idx) AS p FROM spine), sw AS (SELECT doc, seg_idx, start_time AS time, p AS from_language, language AS to_language FROM b WHERE p <> language)"


@query(_SWITCH + " SELECT doc, seg_idx, round(time, 3) AS time, from_language, to_language FROM sw")
def win_switch_points(t):
    return op.switch_points(spine(t)).withColumn("time", numbers.rounded("time", 3))


@query(
    """SELECT conv_id AS doc, turn AS seg_idx, coalesce(lag(role) OVER w <> role, false) AS code_switch_before,
  CASE WHEN lead(role) OVER w <> role THEN text || ' |' ELSE text END AS ipa FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""
)
def win_code_switch_marks(t):
    rows = t("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("seg_idx"), F.col("role").alias("language"), F.col("text").alias("ipa"))
    return op.code_switch_marks(rows).drop("language")


@query(
    _S
    + """, c AS (SELECT doc, seg_idx AS frame_idx, length(language) AS label FROM spine), v AS (SELECT *, [label, coalesce(lag(label) OVER w, a), coalesce(lag(label, 2) OVER w, a), coalesce(lead(label) OVER w, z), coalesce(lead(label, 2) OVER w, z)] AS x
  FROM (SELECT *, first_value(label) OVER (PARTITION BY doc ORDER BY frame_idx) AS a, first_value(label) OVER (PARTITION BY doc ORDER BY frame_idx DESC) AS z FROM c) WINDOW w AS (PARTITION BY doc ORDER BY frame_idx))
SELECT doc, frame_idx, list_sort(x)[3] AS smooth FROM v"""
)
def win_median_smooth(t):
    return op.median_smooth(frames(t).withColumn("label", F.length("label"))).select("doc", "frame_idx", F.col("smooth").cast("long").alias("smooth"))


CLIP = 50  # vectors in a row


def _slope(x, d, source):
    terms = " + ".join(f"{k} * (lead({x}, {k}) OVER w - lag({x}, {k}) OVER w)" for k in (1, 2, 3, 4))
    whole = "(PARTITION BY doc ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    edge = f"CASE WHEN frame_idx < 4 THEN first_value(r IGNORE NULLS) OVER {whole} ELSE last_value(r IGNORE NULLS) OVER {whole} END"
    return f"SELECT * EXCLUDE r, coalesce(r, {edge}) AS {d} FROM (SELECT *, ({terms}) / 60 AS r FROM {source} WINDOW w AS (PARTITION BY doc ORDER BY frame_idx))"


_DELTAS = f"""WITH e AS (SELECT vec_id // {CLIP} AS doc, row_number() OVER (PARTITION BY vec_id // {CLIP} ORDER BY vec_id) - 1 AS frame_idx, embedding[1]::DOUBLE AS x FROM embeddings),
d1 AS ({_slope('x', 'd', 'e')}), d2 AS ({_slope('d', 'dd', 'd1')})"""


@query(_DELTAS + " SELECT doc, frame_idx, CASE WHEN x + d + dd IS NOT NULL THEN [round(x, 6), round(d, 6), round(dd, 6)] END AS features FROM d2")
def win_delta(t):
    """The value with its first and second delta."""
    return op.with_deltas(vectors(t), "x").select("doc", "frame_idx", F.transform("features", lambda v: numbers.rounded(v, 6)).alias("features"))


def vectors(t):
    """Neighbouring vectors are a clip's frames, so that more vectors are more clips."""
    clip = F.floor(F.col("vec_id") / CLIP)
    idx = F.row_number().over(W.partitionBy(clip).orderBy("vec_id")) - 1
    return t("embeddings").select(clip.alias("doc"), idx.alias("frame_idx"), F.get("embedding", F.lit(0)).cast("double").alias("x"), "embedding")


@query(_S + " SELECT doc, seg_idx AS frame_idx, stride::BIGINT AS stride FROM (SELECT *, greatest(1, count(*) OVER (PARTITION BY doc) // 20) AS stride FROM spine) WHERE seg_idx % stride = 0")
def win_stride_downsample(t):
    return op.stride(frames(t), 20).select("doc", "frame_idx", "stride")


_RANKED = "SELECT doc_id, {1} AS c, row_number() OVER (PARTITION BY {1} ORDER BY {2}) AS k, count(*) OVER (PARTITION BY {1}) AS n FROM {0}"
_HASHED = "md5(doc_id || '42'), doc_id"
_PLACED = "SELECT '{0}' AS rule, doc_id, CASE WHEN k <= {1} THEN 'train' WHEN k <= {1} + {2} THEN 'valid' ELSE 'test' END AS split FROM ({3})"
_SPLITS = [
    _PLACED.format("exact", "floor(n * 0.8::DOUBLE)", "floor(n * 0.1::DOUBLE)", _RANKED.format("documents", "0", _HASHED)),
    _PLACED.format("ordered", "floor(n * 0.8::DOUBLE)", "floor(n * 0.1::DOUBLE)", _RANKED.format("documents", "0", "doc_id")),
    _PLACED.format("per_class", "greatest(floor(n * 0.7::DOUBLE), 1)", "greatest(floor(n * 0.15::DOUBLE), 1)", _RANKED.format("documents", "lang", _HASHED)),
]


@query(
    """SELECT 'group' AS rule, doc_id, CASE WHEN k < 800 THEN 'train' WHEN k < 900 THEN 'valid' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(md5(source || '42'), 1, 6))::INT % 1000 AS k FROM documents) UNION ALL """
    + " UNION ALL ".join(_SPLITS)
)
def win_split(t):
    """By the hash of a group, exactly by a seeded hash or in order, and exactly within each class with one row at least."""
    d = t("documents").select("doc_id", "source", "lang")
    rules = {
        "group": op.split_by_group(d, F.col("source")),
        "exact": op.split_exact(d, "doc_id"),
        "ordered": op.split_exact(d, "doc_id", seed=None),
        "per_class": op.split_exact(d, "doc_id", (0.7, 0.15), "lang", least=1),
    }
    return reduce(lambda a, b: a.union(b), (x.select(F.lit(rule).alias("rule"), "doc_id", "split") for rule, x in rules.items()))


@query(
    """SELECT conv_id, turn, round(coalesce(sum(CASE WHEN length(text) > 0 THEN length(text) / 10 + 0.5 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS "offset" FROM conversations"""
)
def win_timeline(t):
    rows = t("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("seg_idx"), (F.length("text") / 10).alias("d"))
    return op.timeline(rows, "d").select(F.col("doc").alias("conv_id"), F.col("seg_idx").alias("turn"), numbers.rounded("offset", 4).alias("offset"))


def _sliced(t, windows):
    return t("documents").select("doc_id", F.posexplode(windows).alias("chunk_idx", "w")).select("doc_id", "chunk_idx", F.col("w.start").alias("start"), F.col("w.end").alias("end"))


_SLICE = """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS chunk_idx, start, "end" FROM ({})"""


@query(_SLICE.format('SELECT doc_id, s AS start, s + 500 AS "end" FROM (SELECT doc_id, n_chars, unnest(range(0, greatest(n_chars - 499, 0), 250)) AS s FROM documents)'))
def slice_sliding(t):
    return _sliced(t, op.sliding(F.col("n_chars"), 500, 250))


@query(_SLICE.format('SELECT doc_id, s AS start, least(s + 1000, n_chars) AS "end" FROM (SELECT doc_id, n_chars, unnest(range(0, greatest(n_chars - 200, 0), 500)) AS s FROM documents)'))
def slice_sliding_tail(t):
    return _sliced(t, op.sliding_tail(F.col("n_chars"), 1000, 500, 200))


@query(
    _SLICE.format(
        'SELECT doc_id, s AS start, s + 400 AS "end" FROM (SELECT doc_id, unnest(range(0, greatest(n_chars - 399, 0), 200)) AS s FROM documents) UNION ALL SELECT doc_id, 0, 400 FROM documents WHERE n_chars < 400 AND n_chars > 100'
    )
)
def slice_padded(t):
    return _sliced(t, op.padded(F.col("n_chars"), 400, 200, 100))


@query(_SLICE.format('SELECT doc_id, s AS start, least(s + 600, n_chars) AS "end" FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars, 600)) AS s FROM documents) WHERE least(s + 600, n_chars) - s >= 50'))
def slice_tumbling(t):
    return _sliced(t, op.tumbling(F.col("n_chars"), 600, 50))


@query("SELECT doc_id, greatest(0, n_chars // 2 - 300) AS start, substr(text, greatest(0, n_chars // 2 - 300) + 1, 600) AS part FROM documents")
def slice_middle(t):
    at = op.middle(F.col("n_chars"), 600)
    return t("documents").select("doc_id", at.alias("start"), F.substring("text", at.cast("int") + 1, F.lit(600)).alias("part"))


@query(
    _S
    + """, w AS (SELECT doc, seg_idx, sum((language = 'view')::INT) OVER f AS k, count(*) OVER f AS n FROM spine WINDOW f AS (PARTITION BY doc ORDER BY seg_idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
SELECT doc, start, share, n_padded FROM (SELECT doc, seg_idx AS start, k / 10 AS share, 10 - n AS n_padded, row_number() OVER (PARTITION BY doc ORDER BY k DESC, seg_idx) AS q FROM w WHERE (n = 10 OR seg_idx = 0) AND seg_idx % 2 = 0) WHERE q = 1"""
)
def slice_best(t):
    return op.best_window(frames(t), F.col("label") == "view", 10, 2)


@query("SELECT vec_id, list_concat(embedding, list_transform(range(16), lambda i: 0::FLOAT))[1:80] AS x FROM embeddings")
def fix_length(t):
    return t("embeddings").select("vec_id", op.fix_length(F.col("embedding"), 80, F.lit(0).cast("float")).alias("x"))


@query("SELECT doc_id || '_' || (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1) AS chunk_id, doc_id, s AS start FROM (SELECT doc_id, unnest(range(0, greatest(n_chars - 499, 0), 250)) AS s FROM documents)")
def win_chunk_ids(t):
    return slice_sliding(t).select(F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_idx").cast("string")).alias("chunk_id"), "doc_id", "start")


# --- intervals: purchases against views, an interval lasts ``value`` minutes ------------------------------------


def intervals(t, kind):
    return spine(t).where(F.col("language") == kind).withColumn("end_time", F.col("start_time") + 60 * F.col("value"))


_I = _S + ", iv AS (SELECT doc, seg_idx, language, start_time, start_time + 60 * value AS end_time FROM spine), a AS (SELECT * FROM iv WHERE language = 'purchase'), b AS (SELECT * FROM iv WHERE language = 'view')"


@query(
    _I
    + """, o AS (SELECT a.doc, a.seg_idx, b.language AS label, b.seg_idx AS other, least(a.end_time, b.end_time) - greatest(a.start_time, b.start_time) AS o FROM a JOIN b USING (doc)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, seg_idx ORDER BY o DESC, other) AS k FROM o WHERE o > 0) WHERE k = 1)
SELECT a.doc, a.seg_idx, coalesce(best.label, a.language) AS label FROM a LEFT JOIN best USING (doc, seg_idx)"""
)
def join_max_overlap(t):
    return op.join_max_overlap(intervals(t, "purchase"), intervals(t, "view"), 21600.0).select("doc", "seg_idx", "label")


@query(
    _I
    + """, d AS (SELECT a.doc, a.seg_idx, b.seg_idx AS ref_idx, abs((a.start_time + a.end_time) / 2 - (b.start_time + b.end_time) / 2) AS dist FROM a JOIN b USING (doc))
SELECT doc, seg_idx, ref_idx, round(dist, 3) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY doc, seg_idx ORDER BY dist, ref_idx) AS k FROM d WHERE dist <= 7200) WHERE k = 1"""
)
def join_nearest_midpoint(t):
    return op.join_nearest_midpoint(intervals(t, "purchase"), intervals(t, "view"), 7200.0).withColumn("dist", numbers.rounded("dist", 3))


_NEAR = _SWITCH + """, tr AS (SELECT doc, time FROM sw WHERE to_language = 'purchase'), pr AS (SELECT doc, time FROM sw WHERE to_language = 'view'),
ne AS (SELECT tr.doc, tr.time, coalesce((SELECT min(abs(pr.time - tr.time)) FROM pr WHERE pr.doc = tr.doc) * 1000, 'infinity'::DOUBLE) AS error_ms FROM tr)"""


def switches(t):
    s = op.switch_points(spine(t))
    return s.where("to_language = 'purchase'"), s.where("to_language = 'view'")


@query(_NEAR + " SELECT doc, round(time, 3) AS time, CASE WHEN error_ms < 1e300 THEN round(error_ms, 1) ELSE -1 END AS error_ms FROM ne")
def join_nearest_switch(t):
    n = op.join_nearest_switch(*switches(t))
    return n.select("doc", numbers.rounded("time", 3).alias("time"), F.when(F.col("error_ms") < 1e300, numbers.rounded("error_ms", 1)).otherwise(-1.0).alias("error_ms"))


@query(
    _NEAR
    + """ SELECT count(*) AS n_true, (SELECT count(*) FROM pr) AS n_predicted, round(avg(error_ms), 2) AS mean_error_ms, round(100 * avg((error_ms <= 3600000)::INT), 2) AS pct_within,
  100 * avg((error_ms <= 3600000)::INT) >= 50 AS pass FROM ne WHERE error_ms < 1e300"""
)
def agg_switch_accuracy(t):
    true, predicted = switches(t)
    return op.switch_accuracy(op.join_nearest_switch(true, predicted).where("error_ms < 1e300"), predicted, 3600000.0)


@query(
    _S
    + """, z AS (SELECT doc, min(start_time) AS t0 FROM spine GROUP BY doc), s AS (SELECT doc, seg_idx, language, trunc((start_time - t0) / 3600)::INT AS f, trunc((start_time - t0 + 600 * value) / 3600)::INT AS u FROM spine JOIN z USING (doc)),
n AS (SELECT doc, trunc(max(start_time - t0 + 600 * value) * (1 / 3600::DOUBLE))::INT AS n FROM spine JOIN z USING (doc) GROUP BY doc), sp AS (SELECT doc, unnest(range(0, n)) AS frame_idx FROM n)
SELECT sp.doc, sp.frame_idx::INT AS frame_idx, coalesce(arg_max(language, seg_idx), 'silence') AS label FROM sp LEFT JOIN s ON s.doc = sp.doc AND sp.frame_idx >= f AND sp.frame_idx < u GROUP BY sp.doc, sp.frame_idx"""
)
def join_frame_labels(t):
    """Frames up to the end of a user's last segment."""
    s = spine(t).withColumn("t0", F.min("start_time").over(W.partitionBy("doc")))
    rel = s.select("doc", "seg_idx", "language", (F.col("start_time") - F.col("t0")).alias("start_time"), (F.col("start_time") - F.col("t0") + 600 * F.col("value")).alias("end_time"))
    # whole frames, with the product that frame_labels makes of the segments' ends
    return op.frame_labels(rel, rel.groupBy("doc").agg((F.max("end_time") * F.lit(1 / 3600)).cast("int").alias("n_frames")), 1 / 3600)


@query(_S + " SELECT doc, count(*) AS num_segments, round(coalesce(max(end_time), 0), 3) AS total_duration, count(DISTINCT language) AS n_languages FROM spine GROUP BY doc")
def agg_transcript_rollup(t):
    return op.rollup(spine(t)).withColumn("total_duration", numbers.rounded("total_duration", 3))


@query(_S + " SELECT doc, max(end_time) > 60 AND count(DISTINCT language) <= 1 AS discard FROM spine GROUP BY doc")
def fallback_single_language(t):
    return op.single_language(spine(t))


@query(_S + " SELECT doc, avg((language = 'view')::INT) AS fraction FROM spine GROUP BY doc")
def agg_label_fraction(t):
    return op.label_fraction(spine(t), "language", "view")


@query(_S + " SELECT doc, language AS label FROM (SELECT doc, language, row_number() OVER (PARTITION BY doc ORDER BY count(*) DESC, language) AS k FROM spine GROUP BY doc, language) WHERE k = 1")
def agg_majority(t):
    return op.majority(spine(t), "language")


@query(_S + " SELECT doc, seg_idx, round(end_time - start_time, 4) AS d FROM spine WHERE end_time - start_time >= 0.5")
def filter_min_duration(t):
    return spine(t).where(F.col("end_time") - F.col("start_time") >= 0.5).select("doc", "seg_idx", numbers.rounded(F.col("end_time") - F.col("start_time"), 4).alias("d"))


@query(_S + " SELECT doc, seg_idx, round((start_time + end_time) / 2, 3) AS mid FROM spine")
def fn_segment_midpoint(t):
    return spine(t).select("doc", "seg_idx", numbers.rounded((F.col("start_time") + F.col("end_time")) / 2, 3).alias("mid"))


@query(_S + " SELECT doc, seg_idx, round(greatest(0, least(end_time, n_end) - greatest(start_time, n_start)), 4) AS overlap FROM (SELECT *, lead(start_time) OVER w AS n_start, lead(end_time) OVER w AS n_end FROM spine WINDOW w AS (PARTITION BY doc ORDER BY seg_idx)) WHERE n_start IS NOT NULL")
def fn_overlap(t):
    w = W.partitionBy("doc").orderBy("seg_idx")
    s = spine(t).withColumn("a", F.lead("start_time").over(w)).withColumn("b", F.lead("end_time").over(w)).where("a IS NOT NULL")
    return s.select("doc", "seg_idx", numbers.rounded(F.greatest(F.lit(0.0), F.least("end_time", "b") - F.greatest("start_time", "a")), 4).alias("overlap"))


@query(_S + " SELECT doc, seg_idx, trunc(value * 50)::INT AS frame, trunc(value * 50)::INT / 50 AS seconds FROM spine")
def fn_frame_index(t):
    f = (F.col("value") * 50).cast("int")
    return spine(t).select("doc", "seg_idx", f.alias("frame"), (f / 50).alias("seconds"))


@query("SELECT conv_id, turn, text FROM conversations WHERE trim(text) <> ''")
def drop_empty_segments(t):
    return t("conversations").select("conv_id", "turn", "text").where(F.trim("text") != "")


@query(
    f"""WITH tg AS ({_TAG.replace("doc_id", "conv_id, turn").replace("documents", "conversations WHERE trim(text) <> ''")}),
l AS (SELECT conv_id AS doc, turn AS seg_idx, t5 AS tagged, n5 AS n_terms, trim(u5) AS used, CASE WHEN own + rest > 0 AND own / (own + rest) > 0.05 THEN 'accented' ELSE 'plain' END AS language FROM (
  SELECT *, len(regexp_extract_all(text, '[À-ÿ]')) AS own, len(regexp_extract_all(text, '[a-zA-Z]')) AS rest FROM tg JOIN conversations USING (conv_id, turn))),
s AS (SELECT *, lag(language) OVER w AS p, lead(language) OVER w AS f FROM l WINDOW w AS (PARTITION BY doc ORDER BY seg_idx))
SELECT doc, count(*) AS num_segments, coalesce(sum((p <> language)::INT), 0)::BIGINT AS n_switches, sum(n_terms)::BIGINT AS n_terms,
  md5(string_agg(language || ':' || used || ':' || tagged || CASE WHEN f <> language THEN ' |' ELSE '' END, chr(10) ORDER BY seg_idx)) AS segments FROM s GROUP BY doc"""
)
def job_transcript_enrich(t):
    """Segments without blank text, labelled anew by their script, with terms tagged and switches marked, nested back into documents."""
    rows = t("conversations").where(F.trim("text") != "").select(F.col("conv_id").alias("doc"), F.col("turn").alias("seg_idx"), "text")
    rows = rows.withColumn("language", fn.script_language(F.col("text"), "[À-ÿ]", "accented", other="plain", share=0.05))
    marked = op.code_switch_marks(tag_terms(rows, "text", _PAIRS), "tagged")
    used = F.array_join(F.transform("used", lambda e: e["target"]), " ")
    segment = F.concat_ws(":", "language", used, "tagged").alias("segment")
    doc = marked.groupBy("doc").agg(
        F.count("*").alias("num_segments"), F.sum(F.col("code_switch_before").cast("long")).alias("n_switches"), F.sum(F.size("used").cast("long")).alias("n_terms"), F.array_sort(F.collect_list(F.struct("seg_idx", segment))).alias("segments")
    )
    return doc.withColumn("segments", F.md5(F.array_join(F.transform("segments", lambda s: s["segment"]), "\n").cast("binary")))
