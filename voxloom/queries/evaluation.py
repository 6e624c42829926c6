"""Queries on error rates, curves, counts and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import numbers
from ..functions import text as fn
from ..operators import evaluation as op
from ..sources import sinks
from ..sources.storage import scratch
from . import signal  # noqa: F401  its queries are part of the evaluation
from .registry import ORACLE_SQL, QUERIES, query
from .segments import _S, spine

_W = "list_filter(regexp_split_to_array(lower({}), '[ \\t\\n\\r]+'), lambda x: x <> '')"
_P = f"""p AS (SELECT role, conv_id, turn, {_W.format('text')} AS r, {_W.format('nxt')} AS h, text AS rc, nxt AS hc
  FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL)"""
# edit distances of all pairs at once, one antidiagonal of their tables a step: cur[i + 1] is the cell (i, d - i)
_DP = """x AS (SELECT row_number() OVER () AS id, * FROM ({pairs}) WHERE len(r) > 0 AND len(h) > 0),
dp AS (SELECT id, 0 AS d, list_transform(range(0, len(r) + 1), lambda i: 0) AS cur, list_transform(range(0, len(r) + 1), lambda i: 0) AS prev FROM x
  UNION ALL SELECT dp.id, d + 1, list_transform(range(0, len(r) + 1), lambda i: CASE WHEN d + 1 < i OR d + 1 - i > len(h) THEN 0 WHEN i = 0 THEN d + 1 WHEN d + 1 = i THEN i
    ELSE least(cur[i] + 1, cur[i + 1] + 1, prev[i] + (r[i] <> h[d + 1 - i])::INT) END), cur FROM dp JOIN x ON x.id = dp.id AND d < len(r) + len(h)),
e AS (SELECT mode, role, len(r) AS n, cur[len(r) + 1] AS e FROM dp JOIN x ON x.id = dp.id AND d = len(r) + len(h))"""
_WER = (
    "WITH RECURSIVE "
    + _P
    + ", c AS (SELECT 'concatenated' AS mode, role, flatten(list(r ORDER BY turn)) AS r, flatten(list(h ORDER BY turn)) AS h FROM p GROUP BY conv_id, role), "
    + _DP.format(pairs="SELECT 'pairs' AS mode, role, r, h FROM p UNION ALL SELECT * FROM c")
    + " SELECT mode, coalesce(role, 'overall') AS role, sum(e)::BIGINT AS edits, sum(n)::BIGINT AS words, round(sum(e) / sum(n), 4) AS wer FROM e GROUP BY GROUPING SETS ((mode, role), (mode))"
)
# for the distance of characters each distinct one of a pair becomes a letter of one byte, as the built-in distance counts bytes
_LETTERS = "list_aggregate(list_transform(string_split({}, ''), lambda x: chr(list_position(k, x)::INT)), 'string_agg', '')"


def turn_pairs(t):
    """Whole turns with the next one of their conversation."""
    after = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    pairs = t("conversations").withColumn("nxt", after).where("nxt IS NOT NULL")
    return pairs.select("role", "conv_id", "turn", fn.words(F.col("text")).alias("r"), fn.words(F.col("nxt")).alias("h"), F.col("text").alias("rc"), F.col("nxt").alias("hc"))


def error_rates(t):
    p = turn_pairs(t)
    each = op.wer(p, "role", "r", "h").select(F.lit("pairs").alias("mode"), "*")
    return each.union(op.wer(op.concatenated(p, ["conv_id", "role"], "turn", ["r", "h"]), "role", "r", "h").select(F.lit("concatenated").alias("mode"), "*"))


@query(_WER)
def agg_wer(t):
    """Turn by turn, and with the texts of a role in a conversation as one; each role and overall."""
    return error_rates(t)


@query(
    f"""WITH {_P}, q AS MATERIALIZED (SELECT *, list_distinct(string_split(rc || hc, '')) AS k FROM p)
SELECT conv_id, turn, round(levenshtein({_LETTERS.format('rc')}, {_LETTERS.format('hc')}) / greatest(length(rc), 1), 4) AS cer FROM q"""
)
def agg_cer(t):
    return turn_pairs(t).select("conv_id", "turn", numbers.rounded(op.cer(F.col("rc"), F.col("hc")), 4).alias("cer"))


@query("WITH " + _P + " SELECT conv_id, turn FROM p WHERE trim(rc) <> '' AND trim(hc) <> ''")
def filter_text_pairs(t):
    return turn_pairs(t).where((F.trim("rc") != "") & (F.trim("hc") != "")).select("conv_id", "turn")


_G = "WITH g AS (SELECT doc_id, quality AS gold, CASE WHEN toxic = 1 THEN 2 WHEN n_chars > 1500 THEN 1 ELSE 0 END AS pred, n_chars FROM labels JOIN documents USING (doc_id))"


def gold(t):
    pred = F.when(F.col("toxic") == 1, 2).when(F.col("n_chars") > 1500, 1).otherwise(0)
    return t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("gold"), pred.alias("pred"), "n_chars")


@query(_G + " SELECT * FROM g")
def join_pred_gold(t):
    return gold(t)


@query(_G + " SELECT gold, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1, count(*) FILTER (WHERE pred = 2) AS pred_2 FROM g GROUP BY gold")
def agg_confusion_matrix(t):
    return op.confusion_matrix(gold(t), "gold", "pred", [0, 1, 2])


@query(
    _G
    + """, c AS (SELECT l AS label, count(*) FILTER (WHERE gold = l AND pred = l) AS tp, count(*) FILTER (WHERE pred = l) AS pp, count(*) FILTER (WHERE gold = l) AS ap, avg((gold = pred)::INT) AS accuracy FROM g, (SELECT unnest([0, 1, 2]) AS l) GROUP BY l),
m AS (SELECT label, CASE WHEN pp > 0 THEN tp / pp ELSE 0 END AS p, CASE WHEN ap > 0 THEN tp / ap ELSE 0 END AS r, accuracy FROM c), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)
SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(f1, 4) AS f1, round(accuracy, 4) AS accuracy, round((SELECT avg(f1) FROM f), 4) AS macro_f1 FROM f"""
)
def agg_prf(t):
    return op.prf(gold(t), "gold", "pred", [0, 1, 2]).select("label", *(numbers.rounded(c, 4).alias(c) for c in ("precision", "recall", "f1", "accuracy", "macro_f1")))


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality >= 0")
def filter_valid_frames(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left").where("quality >= 0")


_ROC = """WITH s AS (SELECT n_chars::DOUBLE AS score, sum((quality = 1)::INT) AS p, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1),
c AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w - sum(p) OVER w AS fp, (SELECT sum(p) FROM s) AS P, (SELECT sum(n) - sum(p) FROM s) AS N FROM s WINDOW w AS (ORDER BY score DESC)),
roc AS (SELECT score, fp / N AS fpr, tp / P AS tpr FROM c)"""


def scored(t):
    return t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")


@query(_ROC + " SELECT score, round(fpr, 6) AS fpr, round(1 - tpr, 6) AS fnr FROM roc")
def agg_det_curve(t):
    return op.det_curve(scored(t), "quality", "n_chars").select("score", numbers.rounded("fpr", 6).alias("fpr"), numbers.rounded("fnr", 6).alias("fnr"))


@query(
    _ROC
    + """, b AS (SELECT fpr AS f1, tpr AS t1 FROM roc WHERE fpr + tpr >= 1 ORDER BY score DESC LIMIT 1), a AS (SELECT fpr AS f0, tpr AS t0 FROM roc WHERE fpr + tpr < 1 ORDER BY score LIMIT 1)
SELECT round(f0 + (1 - f0 - t0) / (f1 + t1 - f0 - t0) * (f1 - f0), 5) AS eer, (SELECT round((fpr + 1 - tpr) / 2, 5) FROM roc ORDER BY abs(fpr - 1 + tpr), score DESC LIMIT 1) AS det_eer FROM a, b"""
)
def agg_eer(t):
    e = op.rates_meet(op.roc(scored(t), "quality", "n_chars"))
    return e.select(numbers.rounded("eer", 5).alias("eer"), numbers.rounded("det_eer", 5).alias("det_eer"))


@query(_S + " SELECT doc, min(value) AS min_epsilon, arg_min(seg_idx, value)::DOUBLE AS snr_at_min, arg_min(seg_idx, value) >= 40 AS meets_snr FROM spine WHERE language = 'purchase' GROUP BY doc")
def agg_min_flip(t):
    return op.min_flip(spine(t).withColumn("seg_idx", F.col("seg_idx").cast("double")), "doc", "value", "seg_idx", F.col("language") == "purchase")


@query(_S + " SELECT doc, epoch, best FROM (SELECT doc, seg_idx AS epoch, floor(value)::BIGINT AS best, row_number() OVER (PARTITION BY doc ORDER BY floor(value) DESC, seg_idx) AS k FROM spine) WHERE k = 1")
def agg_best_epoch(t):
    return op.best_epoch(spine(t).withColumn("m", F.floor("value")), "doc", "seg_idx", "m")


@query("SELECT label, round(mean, 6) AS mean FROM (SELECT label, avg(list_avg(list_transform(embedding, lambda x: abs(x)))) AS mean FROM embeddings GROUP BY label) ORDER BY mean LIMIT 1")
def agg_best_model(t):
    m = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size("embedding")
    per = t("embeddings").select("label", m.alias("m")).groupBy("label").agg(F.avg("m").alias("mean"))
    return per.agg(F.min_by("label", "mean").alias("label"), numbers.rounded(F.min("mean"), 6).alias("mean"))


def source_metrics(t):
    metrics = t("documents").groupBy(F.col("source").alias("metric")).agg(F.avg("n_chars").alias("value"))
    # every third source has no threshold
    thresholds = metrics.where(F.substring("metric", 4, 9).cast("int") % 3 != 0).select("metric", F.lit(2400.0).alias("threshold"), F.lit(True).alias("largest"))
    return op.metric_gates(metrics, thresholds)


_GATES = """WITH m AS (SELECT source AS metric, avg(n_chars) AS value, CASE WHEN substr(source, 4)::INT % 3 <> 0 THEN 2400.0::DOUBLE END AS threshold FROM documents GROUP BY source)"""


@query(_GATES + ' SELECT metric, round(value, 3) AS value, threshold, value <= threshold AS pass FROM m')
def agg_metric_gates(t):
    return source_metrics(t).select("metric", numbers.rounded("value", 3).alias("value"), "threshold", "pass")


@query("SELECT source, count(*) AS total, count(quality) AS filled, round(count(quality) / greatest(count(*), 1), 3) AS coverage, count(quality) / greatest(count(*), 1) >= 0.4 AS pass FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def agg_coverage_checks(t):
    rows = t("documents").select("doc_id", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return op.coverage(rows, "source", F.col("quality").isNotNull(), 0.4)


@query(
    """WITH l AS (SELECT source, doc_id, i, lines[i] AS line FROM (SELECT source, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT source, doc_id, string_split(text, chr(10)) AS lines FROM documents))),
ok AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS k, replace(line, ' | ', chr(9)) AS line FROM l WHERE regexp_matches(line, '\\S') AND NOT starts_with(line, '#')),
h AS (SELECT source, count(*) AS n, any_value(contains(line, chr(9)) AND len(list_filter(string_split(trim(line, ' ' || chr(9) || chr(10) || chr(13)), chr(9)), lambda c: NOT regexp_matches(replace(replace(c, '_', ''), ' ', ''), '^\\p{L}+$'))) = 0) FILTER (WHERE k = 1) AS header FROM ok GROUP BY source)
SELECT d.source, coalesce(n - header::INT, 0) AS entries, coalesce(n - header::INT, 0) >= 500 AS pass FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN h USING (source)"""
)
def agg_dictionary_size(t):
    """The lines of a source's documents are its dictionary; cells are set apart by bars in them."""
    lines = t("documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    rows = lines.select("source", F.struct("doc_id", "i").alias("at"), F.replace("line", F.lit(" | "), F.lit("\t")).alias("line"))
    return op.dictionary_size(rows, "source", "line", "at")


@query("SELECT source, count(*) AS n_required, count(*) FILTER (WHERE quality IS NULL) AS n_missing, bool_and(quality IS NOT NULL) AS complete FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def join_required_inventory(t):
    return op.required_inventory(t("documents").select("doc_id", "source"), t("labels"), "doc_id", "source")


# what is measured: metric, SQL of the value, threshold, whether that is the largest value that passes
_MEASURED = [
    ("wer_assistant", f"(SELECT wer FROM ({_WER}) WHERE mode = 'concatenated' AND role = 'assistant')", "0.15", True),
    ("wer_user", f"(SELECT wer FROM ({_WER}) WHERE mode = 'concatenated' AND role = 'user')", "0.25", True),
    ("wer_overall", f"(SELECT wer FROM ({_WER}) WHERE mode = 'concatenated' AND role = 'overall')", None, True),
    ("mcd", f"(SELECT avg(mcd) FROM ({ORACLE_SQL['agg_mcd']}))", "8.0", True),
    ("switches_within", f"(SELECT pct_within FROM ({ORACLE_SQL['agg_switch_accuracy']}))", "50.0", False),
    ("eer", f"(SELECT eer FROM ({ORACLE_SQL['agg_eer']}))", "0.1", True),
    ("snr_at_min", f"(SELECT min(snr_at_min) FROM ({ORACLE_SQL['agg_min_flip']}))", "40.0", False),
    ("dictionary", f"(SELECT min(entries) FROM ({ORACLE_SQL['agg_dictionary_size']}))", "500.0", False),
    ("required", f"(SELECT avg((n_missing = 0)::INT) FROM ({ORACLE_SQL['join_required_inventory']}))", "1.0", False),
    ("accuracy", f"(SELECT max(accuracy) FROM ({ORACLE_SQL['agg_prf']}))", None, False),
    ("macro_f1", f"(SELECT max(macro_f1) FROM ({ORACLE_SQL['agg_prf']}))", None, False),
]
_EVALUATED = (
    "WITH m AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS metric, round({sql}::DOUBLE, 4) AS value, {limit or 'NULL'}::DOUBLE AS threshold, {str(largest).upper()} AS largest" for name, sql, limit, largest in _MEASURED)
    + "), g AS (SELECT metric, value, threshold, CASE WHEN largest THEN value <= threshold ELSE value >= threshold END AS pass FROM m)"
)


def evaluated(t):
    """(metric, value, threshold, pass): every measure is a row of its own table; the table of gates has a row for each."""
    of = lambda name: QUERIES[name](t.spark, t.sf_dir)
    rates = error_rates(t).where("mode = 'concatenated'")
    one = lambda df, name, value: df.select(F.lit(name).alias("metric"), numbers.rounded(value.cast("double"), 4).alias("value"))
    wer = rates.where(F.col("role").isin("assistant", "user", "overall")).select(F.concat(F.lit("wer_"), "role").alias("metric"), numbers.rounded("wer", 4).alias("value"))
    prf = op.prf(gold(t), "gold", "pred", [0, 1, 2]).agg(F.max("accuracy").alias("accuracy"), F.max("macro_f1").alias("macro_f1"))
    parts = [
        wer,
        one(of("agg_mcd").agg(F.avg("mcd").alias("v")), "mcd", F.col("v")),
        one(of("agg_switch_accuracy"), "switches_within", F.col("pct_within")),
        one(of("agg_eer"), "eer", F.col("eer")),
        one(of("agg_min_flip").agg(F.min("snr_at_min").alias("v")), "snr_at_min", F.col("v")),
        one(of("agg_dictionary_size").agg(F.min("entries").alias("v")), "dictionary", F.col("v")),
        one(of("join_required_inventory").agg(F.avg((F.col("n_missing") == 0).cast("int")).alias("v")), "required", F.col("v")),
        prf.unpivot([], ["accuracy", "macro_f1"], "metric", "value").withColumn("value", numbers.rounded("value", 4)),
    ]
    gates = t.spark.createDataFrame([(name, float(limit) if limit else None, largest) for name, _, limit, largest in _MEASURED], "metric string, threshold double, largest boolean")
    return op.metric_gates(reduce(lambda a, b: a.union(b), parts), gates)


@query(_EVALUATED + " SELECT * FROM g")
def job_evaluate(t):
    """All metrics against their gates."""
    return evaluated(t)


@query(
    _EVALUATED
    + """ SELECT * FROM g UNION ALL SELECT 'passed', count(*) FILTER (WHERE pass), NULL, NULL FROM g UNION ALL SELECT 'failed', count(*) FILTER (WHERE NOT pass), NULL, NULL FROM g
UNION ALL SELECT 'skipped', count(*) FILTER (WHERE pass IS NULL), NULL, NULL FROM g"""
)
def sink_eval_report(t):
    """The report of all metrics, written with its summary and read back."""
    path = sinks.report(evaluated(t), scratch(t.spark, "report"))
    return t.spark.read.schema("metric STRING, value DOUBLE, threshold DOUBLE, pass BOOLEAN").json(path)
