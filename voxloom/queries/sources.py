"""Queries that write a table with a sink and read it back with a scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import corpus
from ..sources import readers, sinks
from ..sources.storage import scratch
from .corpus import _FREQ, doc_words, term_frequencies
from .registry import query

_W = "list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+'), lambda x: x <> '')"


@query("SELECT conv_id, turn, role, text FROM conversations")
def sink_jsonl(t):
    path = sinks.jsonl(t("conversations").select("conv_id", "turn", "role", "text"), scratch(t.spark, "jsonl"))
    return readers.jsonl(t.spark, path, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")


@query("SELECT event_id, user_id, event_type, value FROM events")
def scan_jsonl(t):
    path = sinks.jsonl(t("events").select("event_id", "user_id", "event_type", "value"), scratch(t.spark, "jsonl"))
    return readers.jsonl(t.spark, path, "event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE")


@query("SELECT doc_id::VARCHAR AS doc_id, lang, source FROM documents")
def sink_tsv(t):
    path = sinks.tsv(t("documents"), scratch(t.spark, "tsv"), ["doc_id", "lang", "source"])
    return readers.tsv(t.spark, path, {c: [c] for c in ("doc_id", "lang", "source")})


@query("SELECT p_partkey::VARCHAR AS key, trim(p_name) AS name FROM part")
def scan_tsv(t):
    path = sinks.tsv(t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), scratch(t.spark, "tsv"), ["id", "name"])
    return readers.tsv(t.spark, path, {"key": ["key", "id"], "name": ["name", "title"]})


@query("SELECT doc_id::VARCHAR AS key, lang AS value FROM documents WHERE lang <> 'fr'")
def scan_pair_file(t):
    line = F.when(F.col("lang") == "fr", F.col("doc_id").cast("string")).otherwise(F.concat_ws("\t", F.col("doc_id").cast("string"), F.concat(F.lit(" "), "lang")))
    return readers.pair_file(t.spark, sinks.text_lines(t("documents").select(line.alias("value")), scratch(t.spark, "pairs")))


@query("SELECT doc_id, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'valid' END AS split FROM documents")
def scan_splits(t):
    root = sinks.arrays(t("documents").select("doc_id", F.when(F.col("doc_id") % 10 < 8, "train").otherwise("valid").alias("split")), scratch(t.spark, "splits"), ["split"])
    return readers.splits(t.spark, root).select("doc_id", "split")


@query("SELECT 'lang=' || lang AS class, 1::BIGINT AS files FROM documents GROUP BY lang")
def scan_media_listing(t):
    rows = t("documents").select("doc_id", "lang").repartition("lang")
    root = sinks.arrays(rows, scratch(t.spark, "media"), ["lang"])
    return readers.media_listing(t.spark, root, ("parquet",)).groupBy("class").agg(F.count("*").alias("files"))


@query("SELECT n_chars / 1000 AS eer, CASE WHEN doc_id % 3 = 0 THEN doc_id::DOUBLE END AS snr FROM documents")
def scan_metric_json(t):
    value = F.col("n_chars") / 1000
    even = F.col("doc_id") % 2 == 0
    doc = F.struct(F.when(even, value).alias("eer"), F.when(~even, value).alias("test_eer"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("double")).alias("snr"))
    return readers.metric_documents(t.spark, sinks.text_lines(t("documents").select(F.to_json(doc).alias("value")), scratch(t.spark, "metrics")))


@query(
    """WITH r AS (SELECT source AS name, 'data/raw/' || source AS path, min(lang) AS config, list_sort(list(DISTINCT CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'valid' END)) AS splits,
  list_sort(list(DISTINCT lang)) AS languages, CASE WHEN bool_or(contains(text, 'MIT License')) THEN 'MIT' ELSE 'CC0' END AS license, CASE WHEN avg(n_chars) >= 2000 THEN 'high' ELSE 'medium' END AS priority,
  CASE WHEN count(DISTINCT lang) > 1 THEN ['1.1', '2.2'] ELSE ['1.2'] END AS tasks, count(*) > 1 AS enabled FROM documents GROUP BY source)
SELECT * FROM r WHERE enabled AND list_contains(languages, 'de') AND list_contains(tasks, '2.2')"""
)
def scan_dataset_registry(t):
    """The corpora of the documents, written as a registry; those enabled for a language and a task."""
    split = F.when(F.col("doc_id") % 10 < 8, "train").otherwise("valid")
    several = F.count_distinct("lang") > 1
    rows = t("documents").groupBy(F.col("source").alias("name")).agg(
        F.concat(F.lit("data/raw/"), F.first("source")).alias("path"),
        F.min("lang").alias("config"),
        F.sort_array(F.collect_set(split)).alias("splits"),
        F.sort_array(F.collect_set("lang")).alias("languages"),
        F.when(F.bool_or(F.contains("text", F.lit("MIT License"))), "MIT").otherwise("CC0").alias("license"),
        F.when(F.avg("n_chars") >= 2000, "high").otherwise("medium").alias("priority"),
        F.when(several, F.array(F.lit("1.1"), F.lit("2.2"))).otherwise(F.array(F.lit("1.2"))).alias("tasks"),
        (F.count("*") > 1).alias("enabled"),
    )
    registry = readers.dataset_registry(t.spark, sinks.jsonl(rows, scratch(t.spark, "registry")))
    return registry.where(F.col("enabled") & F.array_contains("languages", "de") & F.array_contains("tasks", "2.2"))


_LJ = "trim(regexp_replace(text, '[|\\n\\r]', ' ', 'g'))"


@query(f"SELECT md5(doc_id || '|' || {_LJ} || '|' || lower({_LJ})) AS line FROM documents")
def sink_ljspeech(t):
    path = sinks.text_lines(sinks.ljspeech_lines(t("documents"), "doc_id", "text"), scratch(t.spark, "lj"))
    return t.spark.read.text(path).select(F.md5(F.col("value").cast("binary")).alias("line"))


@query("SELECT CASE WHEN quality = 1 THEN '- ' || doc_id || ' - - bonafide' ELSE '- ' || doc_id || ' - A00 spoof' END AS value FROM labels")
def sink_protocol(t):
    lines = sinks.protocol_lines(t("labels").where("quality = 1"), t("labels").where("quality = 0"), "doc_id")
    return t.spark.read.text(sinks.text_lines(lines, scratch(t.spark, "protocol")))


@query(f"SELECT md5(array_to_string({_W}, ' ')) AS line FROM documents WHERE len({_W}) > 0")
def sink_token_corpus(t):
    lines = t("documents").select(F.array_join(doc_words(), " ").alias("value")).where("value <> ''")
    return t.spark.read.text(sinks.text_lines(lines, scratch(t.spark, "tokens"))).select(F.md5(F.col("value").cast("binary")).alias("line"))


@query(_FREQ + " SELECT term AS key, CASE WHEN freq < 1e-5 THEN 5.0 WHEN freq < 1e-4 THEN 3.0 WHEN freq < 1e-3 THEN 2.0 ELSE 1.0 END::DOUBLE AS value FROM f")
def sink_kv(t):
    table = term_frequencies(t).select(F.col("term").alias("key"), fn.bias_4bin(F.col("freq")).alias("value"))
    return t.spark.read.parquet(sinks.key_values(table, scratch(t.spark, "kv")))


@query(f"SELECT DISTINCT unnest({_W}) AS value FROM conversations ORDER BY value")
def sink_vocab(t):
    words = corpus.word_counts(t("conversations"), doc_words()).select("word").orderBy("word")
    return t.spark.read.text(sinks.text_lines(words, scratch(t.spark, "vocab"), "word"))


@query("SELECT vec_id, label, embedding FROM embeddings")
def sink_arrays(t):
    path = sinks.arrays(t("embeddings").select("vec_id", "label", "embedding"), scratch(t.spark, "arrays"), ["label"])
    return t.spark.read.parquet(path).select("vec_id", F.col("label").cast("int").alias("label"), "embedding")


def _written_transcripts(t):
    rows = t("conversations").select(F.col("conv_id").cast("string").alias("audio_source"), F.col("turn").alias("seg_idx"), "text", F.col("turn").cast("double").alias("start_time"), (F.col("turn") + 1.0).alias("end_time"), F.col("role").alias("language"), F.lit(1.0).alias("confidence"))
    return sinks.documents(rows, scratch(t.spark, "documents"), doc="audio_source")


_BACK = "SELECT conv_id::VARCHAR AS audio_source, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS seg_idx, text, turn::DOUBLE AS start_time, turn + 1.0::DOUBLE AS end_time, role AS language, 1.0::DOUBLE AS confidence FROM conversations"


@query(_BACK)
def scan_transcript(t):
    return readers.transcript(t.spark, _written_transcripts(t))


@query("SELECT conv_id::VARCHAR AS audio_source, count(*) AS num_segments FROM conversations GROUP BY conv_id")
def sink_document(t):
    return t.spark.read.schema("audio_source STRING, num_segments BIGINT").json(_written_transcripts(t))
