"""Sinks: manifests, token corpora, maps, vocabularies, arrays, documents and reports. Each returns its path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> str:
    df.write.json(path)
    return path


def tsv(df: DataFrame, path: str, columns: list[str]) -> str:
    df.select(*columns).write.csv(path, sep="\t", header=True)
    return path


def text_lines(df: DataFrame, path: str, line: str = "value") -> str:
    df.select(F.col(line).cast("string").alias("value")).write.text(path)
    return path


def ljspeech_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id|text|lower(text)``, text trimmed, bars and line ends made spaces."""
    t = F.trim(F.regexp_replace(text, r"[|\n\r]", " "))
    return df.select(F.concat_ws("|", F.col(key).cast("string"), t, F.lower(t)).alias("value"))


def protocol_lines(bonafide: DataFrame, spoof: DataFrame, stem: str) -> DataFrame:
    """``- <stem> - - bonafide`` and ``- <stem> - A00 spoof``, bona fide first, each block by stem."""
    rows = bonafide.select(F.lit(0).alias("b"), F.format_string("- %s - - bonafide", F.col(stem).cast("string")).alias("value"), F.col(stem).alias("s"))
    rows = rows.union(spoof.select(F.lit(1), F.format_string("- %s - A00 spoof", F.col(stem).cast("string")), F.col(stem)))
    return rows.orderBy("b", "s").select("value")


def documents(segments: DataFrame, path: str, doc: str = "doc", idx: str = "seg_idx") -> str:
    """Segments nested into one JSON document per ``doc``, in order, with a roll-up."""
    fields = [c for c in segments.columns if c not in (doc, idx)]
    nested = segments.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(idx, *fields))).alias("segments"), F.count("*").alias("num_segments"))
    nested.write.json(path)
    return path


def arrays(df: DataFrame, path: str, by: list[str]) -> str:
    """Waveforms, features or embeddings as Parquet, partitioned."""
    df.write.partitionBy(*by).parquet(path)
    return path


def key_values(df: DataFrame, path: str) -> str:
    df.write.parquet(path)
    return path


def report(gates: DataFrame, path: str) -> str:
    """The metrics and their gates (metric, value, threshold, pass), and the numbers that passed, failed and were skipped, as JSON."""
    kinds = (("passed", F.col("pass")), ("failed", ~F.col("pass")), ("skipped", F.col("pass").isNull()))
    counts = gates.agg(*(F.count_if(c).cast("double").alias(name) for name, c in kinds)).unpivot([], [name for name, _ in kinds], "metric", "value")
    gates.select("metric", F.col("value").cast("double"), "threshold", "pass").unionByName(counts, allowMissingColumns=True).write.json(path)
    return path
