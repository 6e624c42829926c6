"""The whole Kneser-Ney model of ``language_model``, from grams in blocks.

A gram of three words (a, b, c) goes to the site of its middle word b. There its count is complete, and so are the weights of the context (a, b), the number of
different words before (b, c), and that before b: what is left to be sent for the gram's probability is one entry for each different (a, b), from the site of b to that of a.
A word with more grams than a bucket should hold has several sites, dealt by the word before it; the numbers of its grams of two words are summed by Spark, and their
probabilities sent back to these sites. Which words these are is read from a sample, which decides where grams are counted and nothing else."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.storage import bucketed, kept
from . import gram_blocks as blocks
from .corpus import word_counts
from .language_model import BEGIN, END, UNKNOWN

#: Kinds of rows that a site writes: its grams, entries for other sites, numbers of all its grams, and of words with several sites: the words, their grams of
#: two words by the word before, and by the word after.
GRAMS, ENTRIES, SUMS, WORDS, TAILS, HEADS = range(6)
_SITE = "kind int, site int, target int, grams binary, w1 string, w2 string, c bigint, t bigint, n1 bigint, n2 bigint, n3 bigint, sums array<bigint>"
_SITE_ARROW = pa.schema([("kind", pa.int32()), ("site", pa.int32()), ("target", pa.int32()), ("grams", pa.binary()), ("w1", pa.string()), ("w2", pa.string()), *((k, pa.int64()) for k in ("c", "t", "n1", "n2", "n3")), ("sums", pa.list_(pa.int64()))])
_MODEL = "n int, gram string, p double, backoff double"
#: Bytes of the files that are read for the sample.
SAMPLE = 4 << 20


def discount(t: list[int]) -> tuple[float, float, float]:
    """As ``language_model.discounts``, from the numbers of grams with counts of one to four."""
    usual = (0.5, 1.0, 1.5)  # fixed values: the usual discounts of an order too small for estimates
    if not all(t[:3]):
        return usual
    y = t[0] / (t[0] + 2 * t[1])
    found = tuple(k - (k + 1) * y * t[k] / t[k - 1] for k in (1, 2, 3))
    return found if all(0 <= d <= k for k, d in enumerate(found, 1)) else usual


def _sites(hashed, splits, middle, before, buckets):
    return blocks.deal(hashed[middle] | (hashed[before] % splits[middle]) << np.uint64(32), buckets)


def _found(words: pa.Array, names: list[str], values: list, missing) -> np.ndarray:
    """The value of each of ``words``, which end with a space, by name."""
    at = pc.index_in(words, pa.array([f"{w} " for w in names], pa.string())).to_numpy(zero_copy_only=False)
    at = np.where(np.isnan(at), -1, at).astype(np.int64)
    return np.append(np.array(values), missing)[at] if len(names) else np.full(len(words), missing)


def _number(words: pa.Array, name: str) -> int:
    at = words.index(pa.scalar(f"{name} ", pa.string())).as_py()
    return at if at >= 0 else len(words)  # none


def _levels(counts: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Of runs that begin at ``first``: their sum, and how many counts are one, two, and more."""
    if not len(first):
        return [np.zeros(0, np.int64)] * 4
    one, two = (np.add.reduceat((counts == k).astype(np.int64), first) for k in (1, 2))
    return [np.add.reduceat(counts, first), one, two, np.diff(first, append=len(counts)) - one - two]


def _amount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(counts == 1, d[0], np.where(counts == 2, d[1], d[2]))


def _left(levels: list[np.ndarray], d: tuple[float, float, float]) -> np.ndarray:
    t, n1, n2, n3 = levels
    return (n1 * d[0] + n2 * d[1] + n3 * d[2]) / t


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def common_words(df: DataFrame, text: Column, buckets: int, size: int) -> dict[str, int]:
    """Words with more than a bucket's share of a sample, and how many sites each has: as many words as buckets at most."""
    part = df if size <= SAMPLE else df.sample(max(0.001, SAMPLE / size), seed=1)
    counts = kept(word_counts(part, fn.words(text)), "sample")
    total = counts.agg(F.sum("cnt")).first()[0] or 0
    return {r.word: -(-r.cnt * buckets // total) for r in counts.where(F.col("cnt") * buckets > total).collect()}


def _send(sites: dict[str, int], buckets: int):
    def run(batches):
        def rows():
            for numbers, rest, words in blocks.word_blocks(batches, 2, [BEGIN, END, UNKNOWN]):
                at = np.flatnonzero(rest >= 2)
                (b, a, c), counts = blocks.distinct([numbers[at + 1], numbers[at], numbers[at + 2]], len(words))
                hashed, splits = blocks.hashes(words), _found(words, list(sites), list(sites.values()), 1).astype(np.uint64)
                yield from blocks.packed(_sites(hashed, splits, b, a, buckets), [b, a, c], [counts], words)

        yield from blocks.sent(rows(), pa.schema([("bucket", pa.int32()), ("grams", pa.binary())]))

    return run


def _count(sites: dict[str, int], buckets: int):
    """The grams of a site, summed, and what other sites, and Spark, need of them."""

    def batch(n, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SITE_ARROW], schema=_SITE_ARROW)

    def one(site, rows):
        words, (b, a, c), (counts,) = blocks.merged(rows, 3, 1)
        (b, a, c), counts = blocks.distinct([b, a, c], len(words), counts)
        hashed = blocks.hashes(words)
        splits = _found(words, list(sites), list(sites.values()), 1).astype(np.uint64)
        common, begin, end = splits > 1, _number(words, BEGIN), _number(words, END)
        yield batch(1, kind=[GRAMS], site=[site], grams=[blocks.pack(blocks.raw(words), [blocks.narrow(x) for x in (b, a, c, counts)])])
        first = blocks.runs([b, a])
        context, cb, ca = _levels(counts, first), b[first], a[first]
        word = blocks.runs([cb])
        wb, before = cb[word], np.diff(word, append=len(cb))
        (tb, tc), tails = blocks.distinct([b, c], len(words))
        light, begins, seldom = ~common[tb], context[0][ca == begin], before[~common[wb]]
        twos = [x + y for x, y in zip(_of_counts(tails[light]), _of_counts(begins))]
        of_begin = [int(begins.sum()), *(k := _of_counts(begins)[:2]), len(begins) - sum(k)]
        sums = [*_of_counts(counts), *twos, *_of_counts(seldom), int((seldom > 2).sum()), int(seldom.sum()), len(seldom), *of_begin, int((tc[light] == end).sum())]
        yield batch(1, kind=[SUMS], site=[site], sums=[sums])
        # a word with several sites has no complete number here
        after = np.where(common[cb], 0, np.repeat(before, np.diff(word, append=len(cb))))
        own = np.flatnonzero((ca != begin) & ~common[ca])
        to = _sites(hashed, splits, ca[own], ca[own], buckets)
        held, size = [], 0
        for row in blocks.packed(to, [ca[own], cb[own]], [after[own], *(x[own] for x in context)], words):
            held.append(row)
            size += len(row[1])
            if size > 4 << 20:
                yield batch(len(held), kind=[ENTRIES] * len(held), site=[site] * len(held), target=[r[0] for r in held], grams=[r[1] for r in held])
                held, size = [], 0
        if held:
            yield batch(len(held), kind=[ENTRIES] * len(held), site=[site] * len(held), target=[r[0] for r in held], grams=[r[1] for r in held])
        names = blocks.bare(words)
        own = np.flatnonzero(common[wb])
        yield batch(len(own), kind=[WORDS] * len(own), site=[site] * len(own), w1=names.take(pa.array(wb[own])), c=before[own])
        for kind, own, w1, w2, more in (
            (TAILS, np.flatnonzero(~light), tb, tc, {"c": tails}),
            (HEADS, np.flatnonzero((ca != begin) & common[ca]), ca, cb, dict(zip(("c", "t", "n1", "n2", "n3"), (after, *context)))),
        ):
            for at in range(0, len(own), blocks.BATCH):
                i = own[at : at + blocks.BATCH]
                yield batch(len(i), kind=[kind] * len(i), site=[site] * len(i), w1=names.take(pa.array(w1[i])), w2=names.take(pa.array(w2[i])), **{k: v[i] for k, v in more.items()})

    def run(batches):
        rows: dict[int, list[bytes]] = {}
        for b in batches:
            for site, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.setdefault(site, []).append(row)
        for site in list(rows):
            yield from one(site, rows.pop(site))

    return run


def _estimate(common: dict[str, int], d: dict[int, tuple], total: int, even: float, ends: int, begin_total: int, begin_left: float):
    """The model's rows of a site: ``common`` are the words with several sites and the different words before them."""

    def p1(before):
        return (before - _amount(before, d[1])) / total + even

    def run(key, left, right):
        out = []

        def put(n, grams, p, backoff):
            for at in range(0, len(p), blocks.BATCH):
                to = at + blocks.BATCH
                own = blocks.joined(names, [g[at:to] for g in grams])
                out.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(own), n, np.int32)), own, pa.array(p[at:to]), pa.array(backoff[at:to])], names=["n", "gram", "p", "backoff"]))

        if not left.num_rows:
            raise ValueError(f"site {key} has entries and no grams")
        raw, (b, a, c, counts) = blocks.unpack(left.column("grams")[0].as_py(), 4)
        words = blocks.cut(raw)
        b, a, c, counts, size = b.astype(np.int64), a.astype(np.int64), c.astype(np.int64), counts.astype(np.int64), len(words)
        names = blocks.bare(words)
        many = _found(words, list(common), list(common.values()), 0).astype(np.int64)
        begin, end = _number(words, BEGIN), _number(words, END)
        (tb, tc), tails = blocks.distinct([b, c], size)
        tails = tails.astype(np.int64)
        key_of = tb.astype(np.int64) * size + tc
        light = many[tb] == 0
        p2, last, backoff = np.zeros(len(tb)), np.full(len(tb), ends, np.int64), np.ones(len(tb))

        def in_order(first, second, need):
            """Where the grams of the right table come in the order of the tails ``need``, which they all are."""
            at = np.argsort(k := first * size + second)
            if not np.array_equal(k[at], key_of[need]):
                raise ValueError("entries are missing or too many")
            return at

        is_entry = pc.is_valid(right.column("entries"))
        xw, (xa, xb), more = blocks.merged(right.column("entries").filter(is_entry).to_pylist(), 2, 5)
        of = pc.index_in(xw, words).to_numpy(zero_copy_only=False).astype(np.int64)
        need = np.flatnonzero(light & (tc != end))
        at = in_order(of[xa], of[xb], need)
        after, *context = (x[at] for x in more)
        last[need] = np.where(after == 0, many[tc[need]], after)
        backoff[need] = _left(context, d[3])
        # words with one site: their grams of two words are all here
        first = blocks.runs([tb])
        sums = _levels(tails, first)
        of_word = np.repeat(np.arange(len(first)), np.diff(first, append=len(tb)))
        word_left = _left(sums, d[2])
        p2 = (tails - _amount(tails, d[2])) / sums[0][of_word] + word_left[of_word] * p1(last)
        back = right.filter(pc.invert(is_entry))
        need = np.flatnonzero(~light)
        w1, w2 = (pc.index_in(pc.binary_join_element_wise(back.column(w).combine_chunks(), "", " "), words).to_numpy(zero_copy_only=False).astype(np.int64) for w in ("w1", "w2"))
        p2[need] = back.column("p").to_numpy()[in_order(w1, w2, need)]
        put(2, [tb[light], tc[light]], p2[light], backoff[light])
        first = blocks.runs([b, a])
        context, cb, ca = _levels(counts, first), b[first], a[first]
        context_left = _left(context, d[3])
        word = blocks.runs([cb])
        wb, before = cb[word], np.diff(word, append=len(cb))
        before = np.where(many[wb] == 0, before, many[wb])
        seldom = many[wb] == 0
        put(1, [wb[seldom]], p1(before[seldom]), word_left[seldom])  # words here and of the tails are the same, in order
        own = np.flatnonzero(ca == begin)
        c2 = context[0][own]
        put(2, [ca[own], cb[own]], (c2 - _amount(c2, d[2])) / max(begin_total, 1) + begin_left * p1(np.repeat(before, np.diff(word, append=len(cb)))[own]), context_left[own])
        of_context = np.repeat(np.arange(len(first)), np.diff(first, append=len(b)))
        low = p2[np.searchsorted(key_of, b * size + c)]
        put(3, [a, b, c], (counts - _amount(counts, d[3])) / context[0][of_context] + context_left[of_context] * low, np.ones(len(b)))
        return pa.Table.from_batches(out)

    return run


def estimate(df: DataFrame, text: Column, sites: dict[str, int] | None = None, buckets: int | None = None) -> DataFrame:
    """(n, gram, p, backoff) of the words of texts, as ``language_model.kneser_ney`` of ``sentence_grams`` has them, of order 3. ``sites`` (words and numbers of sites) are read from a sample if
    they aren't given. Without sentences only the mark of the beginning is left."""
    spark = df.sparkSession
    buckets = buckets or 2 * blocks.bucket_count(df)
    sites = common_words(df, text, buckets, blocks.bytes_of(df)) if sites is None else sites
    sites = {w: k for w, k in sites.items() if k > 1 and w not in (BEGIN, END, UNKNOWN)}
    sent = df.select(blocks.line(text, BEGIN, END).alias("words")).mapInArrow(_send(sites, buckets), "bucket int, grams binary")
    table = bucketed(sent.repartitionById(buckets, F.col("bucket")).select("bucket", "grams").mapInArrow(_count(sites, buckets), _SITE), "site", buckets, "sites")
    of_kind = lambda k: table.where(F.col("kind") == k)
    s = of_kind(SUMS).select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    s = [v for _, v in sorted((r.i, r.v) for r in s)] or [0] * 20
    threes, twos, ones, (ones_more, total, kinds), begin, ends = s[:4], s[4:8], s[8:12], s[12:15], s[15:19], s[19]
    common: dict[str, tuple] = {}
    if sites:
        numbers = ("c", "t", "n1", "n2", "n3")
        tails = of_kind(TAILS).select("site", "w1", "w2", "c")
        parts = tails.select("w1", "w2", F.col("c").alias("c2"), *(F.lit(None).cast("long").alias(k) for k in numbers)).union(of_kind(HEADS).select("w1", "w2", F.lit(0).cast("long"), *numbers))
        pairs = kept(parts.groupBy("w1", "w2").agg(F.sum("c2").alias("c2"), *(F.max(k).alias(k) for k in numbers)), "pairs")
        count_if = lambda x: F.sum(x.cast("long"))
        c2 = F.col("c2")
        by_word = pairs.groupBy("w1").agg(F.sum(c2).alias("t"), count_if(c2 == 1), count_if(c2 == 2), count_if(c2 > 2), F.max((F.col("w2") == END).cast("int")), *(count_if(c2 == k) for k in (1, 2, 3, 4))).collect()
        before = {r.w1: r.c for r in of_kind(WORDS).groupBy("w1").agg(F.sum("c").alias("c")).collect()}
        for w, t, n1, n2, n3, ended, *of_counts in by_word:
            common[w] = (before[w], t, n1, n2, n3)
            twos = [x + y for x, y in zip(twos, of_counts)]
            ends += ended
    alone = [v[0] for v in common.values()] + ([ends] if ends else [])
    ones = [x + alone.count(k) for k, x in enumerate(ones, 1)]
    ones_more, total, kinds = ones_more + sum(k > 2 for k in alone), total + sum(alone), kinds + len(alone)
    d = {1: discount(ones), 2: discount(twos), 3: discount(threes)}
    special = [(1, BEGIN, 0.0, (begin[1] * d[2][0] + begin[2] * d[2][1] + begin[3] * d[2][2]) / begin[0] if begin[0] else 1.0)]
    if not total:
        return spark.createDataFrame(special, _MODEL)
    even = (ones[0] * d[1][0] + ones[1] * d[1][1] + ones_more * d[1][2]) / total / (kinds + 1)
    cut = lambda k, n: d[n][min(k, 3) - 1]
    p1 = lambda k: (k - cut(k, 1)) / total + even
    left = {w: (n1 * d[2][0] + n2 * d[2][1] + n3 * d[2][2]) / t for w, (_, t, n1, n2, n3) in common.items()}
    special += [(1, UNKNOWN, even, 1.0), (1, END, p1(ends), 1.0), *((1, w, p1(v[0]), left[w]) for w, v in common.items())]
    right = of_kind(ENTRIES).select(F.col("target").alias("site"), F.col("grams").alias("entries"), F.lit(None).cast("string").alias("w1"), F.lit(None).cast("string").alias("w2"), F.lit(None).cast("double").alias("p"))
    more = spark.createDataFrame(special, _MODEL)
    if common:
        amount = lambda x, n: F.when(x == 1, d[n][0]).when(x == 2, d[n][1]).otherwise(d[n][2])
        heads = F.broadcast(spark.createDataFrame([(w, v[1], left[w]) for w, v in common.items()], "w1 string, total bigint, left double"))
        lasts = F.broadcast(spark.createDataFrame([(END, ends), *((w, v[0]) for w, v in common.items())], "w2 string, before bigint"))
        c1 = F.coalesce("before", "c")  # words with several sites had none
        low = (c1 - amount(c1, 1)) / total + even
        p2 = pairs.join(heads, "w1").join(lasts, "w2", "left").select("w1", "w2", ((F.col("c2") - amount(F.col("c2"), 2)) / F.col("total") + F.col("left") * low).alias("p"), F.coalesce((F.col("n1") * d[3][0] + F.col("n2") * d[3][1] + F.col("n3") * d[3][2]) / F.col("t"), F.lit(1.0)).alias("backoff"))
        right = right.union(tails.join(p2, ["w1", "w2"]).select("site", F.lit(None).cast("binary"), "w1", "w2", "p"))
        more = more.union(p2.select(F.lit(2), F.concat_ws(" ", "w1", "w2"), "p", "backoff"))
    run = _estimate({w: v[0] for w, v in common.items()}, d, total, even, ends, begin[0], special[0][3])
    return of_kind(GRAMS).select("site", "grams").groupBy("site").cogroup(right.groupBy("site")).applyInArrow(run, _MODEL).union(more)
