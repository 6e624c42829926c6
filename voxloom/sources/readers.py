"""Scans of transcripts, manifests, pair files, splits, listings and metric documents. Schemas are declared, not inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def transcript(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """(audio_source, seg_idx, segment columns): documents with ``segments`` or ``translations``, or a list of segments."""
    entries = schemas.SEGMENT.replace(" STRING", ": STRING").replace(" DOUBLE", ": DOUBLE")
    schema = f"{schemas.TRANSCRIPT}, translations ARRAY<STRUCT<{entries}>>, {schemas.SEGMENT}"
    rows = spark.read.schema(schema).option("multiLine", multiline).json(path)
    nested = rows.select("audio_source", F.coalesce("segments", "translations").alias("s"), F.struct(*(c.split()[0] for c in schemas.SEGMENT.split(", "))).alias("own"))
    # a top-level list comes as rows that are segments themselves
    return nested.select("audio_source", F.posexplode_outer(F.coalesce("s", F.array("own"))).alias("seg_idx", "e")).select("audio_source", "seg_idx", "e.*")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def tsv(spark: SparkSession, path: str, aliases: dict[str, list[str]]) -> DataFrame:
    """Tab-separated with a header; each column is the first non-null of its aliases, trimmed."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(*(F.trim(F.coalesce(*(F.col(c) for c in names if c in rows.columns))).alias(out) for out, names in aliases.items()))


def pair_file(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of lines with two tab fields at least; the last of equal keys, by file and line."""
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n")).alias("at"))
    parts = F.split("value", "\t")
    pairs = lines.where(F.size(parts) >= 2).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("v"), "at")
    return pairs.groupBy("key").agg(F.max_by("v", "at").alias("value"))


def splits(spark: SparkSession, root: str, keep: tuple[str, ...] = ("train", "valid", "test")) -> DataFrame:
    """Rows of root/split=*; the directories prune the scan, and absent ones are skipped."""
    return spark.read.parquet(root).where(F.col("split").isin(*keep))


def media_listing(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("wav", "npy", "flac")) -> DataFrame:
    """(class, path, length) of files with the suffixes, by their directory; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class"), "path", "length")


def metric_documents(spark: SparkSession, path: str) -> DataFrame:
    """(eer, snr) by the first key that is there."""
    rows = spark.read.schema(schemas.METRICS).json(path)
    return rows.select(F.coalesce("eer", "test_eer").alias("eer"), F.coalesce("snr_db", "snr", "snr_at_min_db").alias("snr"))


def dataset_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry of corpora, one JSON object a corpus, with its languages, splits and tasks as arrays."""
    return spark.read.schema(schemas.REGISTRY).json(path)


def spread(df: DataFrame, least: int = 4 << 20) -> DataFrame:
    """``df``, dealt to all cores if it has fewer partitions than these and ``least`` bytes or more: a file of one row group
    is one task otherwise, whatever is exploded from it. Tables of many files stay as they are."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution()
    cores = spark.sparkContext.defaultParallelism
    if plan.optimizedPlan().stats().sizeInBytes() < least or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def dealt(df: DataFrame, each: int = 4 << 20) -> DataFrame:
    """A table, dealt to tasks of about ``each`` bytes of its files if its partitions are larger: what a task counts of its rows stays in memory."""
    plan = df._jdf.queryExecution()
    wanted = -(-int(plan.optimizedPlan().stats().sizeInBytes()) // each)
    return df.repartition(wanted) if plan.toRdd().getNumPartitions() < wanted < 1 << 31 else df  # tables of unknown size stay
