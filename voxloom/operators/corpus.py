"""Corpora and n-grams: cleaning, hashing, counting, set operations."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as fn
from ..functions.numbers import rounded
from . import gram_blocks as blocks


def normalize_pairs(df: DataFrame, source: list[str], target: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(src, tgt): first non-null of the aliases; pairs with an empty side go, then both are trimmed."""
    s, t = (F.coalesce(*(F.col(c) for c in names if c in df.columns)) for names in (source, target))
    return df.select(s.alias("src"), t.alias("tgt"), *keep).where("src <> '' AND tgt <> ''").select(F.trim("src").alias("src"), F.trim("tgt").alias("tgt"), *keep)


def filter_nonblank(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.trim(column)).where(F.col(column) != "")


def filter_language(df: DataFrame, keep: list[str], names: tuple[str, ...] = ("language", "lang", "label", "lang_code")) -> DataFrame:
    column = next((c for c in names if c in df.columns), None)
    return df if column is None else df.where(F.col(column).isin(keep))


def dedup_pairs(df: DataFrame, source: str, target: str, order: str) -> DataFrame:
    """The first row, by ``order``, of each pair; only the key and the row itself are shuffled, and combined before."""
    rest = [c for c in df.columns if c != "pair_key"]
    keyed = df.select(fn.pair_key(F.col(source), F.col(target)).alias("pair_key"), F.struct(*rest).alias("row"), F.col(order).alias("at"))
    return keyed.groupBy("pair_key").agg(F.min_by("row", "at").alias("row")).select("pair_key", "row.*")


def gram_size(gram: Column) -> Column:
    return F.length(gram) - F.length(F.replace(gram, F.lit(" "), F.lit(""))) + 1


def ngram_counts(df: DataFrame, tokens: Column, max_n: int = 3) -> DataFrame:
    """(n, gram, cnt) of all grams inside a sentence, tokens joined by spaces (tokens have none). See ``text_ngram_counts``."""
    return _ngram_counts(df, F.concat(F.array_join(tokens, " "), F.lit(" ")), max_n)


def text_ngram_counts(df: DataFrame, text: Column, max_n: int = 3) -> DataFrame:
    """(n, gram, cnt) of all grams of the words of a text, in lower case, from one scan and one shuffle. Only grams of ``max_n`` words, shorter ones at the ends
    of sentences, and words are sent, counted within blocks; grams of two words or more that begin with the same two meet in one bucket, where those between
    are their heads."""
    return _ngram_counts(df, blocks.line(text), max_n)


def _ngram_counts(df: DataFrame, line: Column, max_n: int) -> DataFrame:
    buckets = blocks.bucket_count(df)

    def counted(batches):
        def rows():
            for numbers, rest, words in blocks.word_blocks(batches, max_n - 1):
                n, none = len(rest), len(words)
                columns = [numbers[:n]]
                for k in range(1, max_n):
                    c = np.full(n, none, np.int32)
                    own = numbers[k : k + n]
                    c[: len(own)] = np.where(rest[: len(own)] >= k, own, none)
                    columns.append(c)
                hashed = blocks.hashes(words)
                single = np.bincount(columns[0], minlength=none)
                found = np.flatnonzero(single)
                grams, cnt = [[found], *([np.full(len(found), none)] for _ in range(max_n - 1))], [single[found]]
                if max_n > 1:
                    longer = rest > 0
                    own, c = blocks.distinct([c[longer] for c in columns], none + 1)
                    grams, cnt = [[*g, o] for g, o in zip(grams, own)], [*cnt, c]
                grams, cnt = [np.concatenate(g) for g in grams], np.concatenate(cnt)
                key = hashed[grams[0]] if max_n == 1 else hashed[grams[0]] << np.uint64(32) | hashed[grams[1]]
                yield from blocks.packed(blocks.deal(key, buckets), grams, [cnt], words)

        yield from blocks.sent(rows(), pa.schema([("bucket", pa.int32()), ("grams", pa.binary())]))

    def summed(batches):
        words, columns, (cnt,) = blocks.merged((r for b in batches for r in b.column(1).to_pylist()), max_n, 1)
        none = len(words)
        columns, cnt = blocks.distinct(columns, none + 1, cnt)
        words = blocks.bare(words)
        for n in range(max_n, 0, -1):
            # rows are sorted, so that those with the same head are neighbours; words come by themselves
            has = columns[n - 1] < none if n > 1 else columns[1] == none if max_n > 1 else np.ones(len(cnt), bool)
            own, c = [g[has] for g in columns[:n]], cnt[has]
            first = blocks.runs(own)
            total = np.add.reduceat(c, first) if len(first) else c
            for at in range(0, len(first), blocks.BATCH):
                here = first[at : at + blocks.BATCH]
                gram = blocks.joined(words, [g[here] for g in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), n, np.int32)), gram, pa.array(total[at : at + blocks.BATCH])], names=["n", "gram", "cnt"])

    return df.select(line.alias("words")).mapInArrow(counted, "bucket int, grams binary").repartitionById(buckets, F.col("bucket")).select("bucket", "grams").mapInArrow(summed, "n int, gram string, cnt bigint")


def word_counts(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.explode(tokens).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def term_frequency(terms: DataFrame, counts: DataFrame, term: str = "term") -> DataFrame:
    """Adds cnt and freq, the share of all words; 0 for unknown terms. The total is one row."""
    total = counts.agg(F.greatest(F.coalesce(F.sum("cnt"), F.lit(0)), F.lit(1)).alias("total"))
    known = terms.join(counts.withColumnRenamed("word", term), term, "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    return known.join(F.broadcast(total)).withColumn("freq", F.col("cnt") / F.col("total")).drop("total")


def union_corpora(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_vocabulary(a: DataFrame, b: DataFrame, word: str = "word") -> DataFrame:
    return a.select(word).union(b.select(F.lower(word))).distinct()


def except_terms(terms: DataFrame, found: DataFrame) -> DataFrame:
    return terms.subtract(found)


def distinct_words(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(fn.words(F.col(text), lower=False)).alias("word")).distinct()


def category_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("cnt"))


def speaker_stats(df: DataFrame, speaker: str, duration: str, gender: str, order: str) -> DataFrame:
    return (
        df.groupBy(F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker_id"))
        .agg(F.min_by(gender, order).alias("gender"), F.count("*").alias("num_utterances"), F.round(F.sum(duration), 2).alias("total_duration_sec"), rounded(F.avg(duration), 2).alias("avg_duration_sec"))
        .orderBy("speaker_id")
    )


def terms_by_domain(df: DataFrame, domain: str, term: str, order: str) -> DataFrame:
    """(term_key, domain, domain_terms): the first domain of each term, whatever its case, and how many terms that has."""
    first = df.groupBy(F.lower(term).alias("term_key")).agg(F.min_by(domain, order).alias("domain"))
    return first.join(first.groupBy("domain").agg(F.count("*").alias("domain_terms")), "domain").select("term_key", "domain", "domain_terms")


def balance_classes(df: DataFrame, label: str, key: str, seed: str = "42") -> DataFrame:
    """As many rows of each class as the smallest has, the first by a seeded hash. The hash is cut into ranges first, so
    that no class is sorted in one task: whole ranges are taken, and rows are ranked in the last one only."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"))
    rows = df.withColumn("_digest", digest).withColumn("_range", F.substring("_digest", 1, 3))
    sizes = rows.groupBy(label, "_range").agg(F.count("*").alias("_n"))  # 4096 ranges a class
    least = sizes.groupBy(label).agg(F.sum("_n").alias("_n")).agg(F.min("_n").alias("_least"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(label).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = sizes.withColumn("_before", before).join(F.broadcast(least)).where("_before < _least").drop("_n")
    rank = F.row_number().over(W.partitionBy(label, "_range").orderBy("_digest", key))
    return rows.join(taken, [label, "_range"]).withColumn("_rank", rank).where("_before + _rank <= _least").select(*df.columns)
