"""Grams of words in blocks: a task numbers the words of its texts, sorts their grams as numbers, and sends each bucket one row with the
grams of a block that fall into it and their words. A gram is a row of word numbers; those of one bucket are merged by one task.

Blocks and buckets are bounded, whatever the size of the tables. Texts are cut at white space by whole arrays of their bytes; words are kept with a space
after each."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a block, and grams of one batch of results.
BLOCK, BATCH = 1 << 21, 1 << 16
#: Bytes of a table's files whose grams make a bucket.
BUCKET = 8 << 20


def line(text: Column, before: str = "", after: str = "") -> Column:
    """A text, in lower case, with words before and after it, as ``word_blocks`` reads them."""
    return F.concat(F.lit(before and before + " "), F.lower(F.coalesce(text, F.lit(""))), F.lit(f" {after} " if after else " "))


def bytes_of(df: DataFrame) -> int:
    """Bytes of a table's files, as Spark plans with them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame) -> int:
    """Two for each core, more for larger tables; those of unknown size take the number of shuffle partitions."""
    size, spark = bytes_of(df), df.sparkSession
    wanted = -(-size // BUCKET) if size < 1 << 50 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * spark.sparkContext.defaultParallelism, wanted)


def _strings(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array without nulls."""
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    return offsets - offsets[0], np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


def cut(data: np.ndarray) -> pa.Array:
    """The words of bytes in which each ends with a space, with it."""
    ends = np.flatnonzero(data == 32).astype(np.int32) + 1
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(data))


_SPACE = np.isin(np.arange(256), [9, 10, 13, 32])  # as functions.text.SPACE


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of rows that end at ``ends`` with white space, and how many there are up to the end of each."""
    space = _SPACE[data]
    last = space.copy()
    last[1:] &= ~space[:-1]
    last[:1] = False  # white space before the first word
    up_to = np.searchsorted(np.flatnonzero(last), ends)
    keep = ~space | last
    words = data[keep]
    words[last[keep]] = 32
    return cut(words), up_to


def _without(words: pa.Array, ends: np.ndarray, names: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Leave ``names`` out, but for the first and the last word of each row."""
    keep = ~pc.is_in(words, pa.array([f"{n} " for n in names], pa.string())).to_numpy(zero_copy_only=False)
    keep[ends - 1] = True
    keep[np.append(0, ends[:-1])] = True
    return words.filter(pa.array(keep)), np.cumsum(keep)[ends - 1]


def word_blocks(batches: Iterable[pa.RecordBatch], ahead: int, marks: list[str] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(numbers of words, how many words follow in the row, the distinct words) of blocks of rows made by ``line``. A block has the numbers of up to
    ``ahead`` words more than it tells followers of: those of the next block. Each row begins and ends with one of ``marks``, if there are any, which are
    left out elsewhere."""

    def blocks():
        words = pa.concat_arrays([w for w, _ in held])
        rest = np.concatenate([r for _, r in held])
        for at in range(0, len(words), BLOCK):
            d = words[at : at + BLOCK + ahead].dictionary_encode()
            yield d.indices.to_numpy(), rest[at : at + BLOCK], d.dictionary

    held: list[tuple[pa.Array, np.ndarray]] = []
    for batch in batches:
        offsets, data = _strings(batch.column(0))
        # a few million words at a time, unless a single row has more
        cuts = np.unique(np.append(np.searchsorted(offsets, np.arange(0, len(data), 8 * BLOCK)), len(offsets) - 1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            own = offsets[lo : hi + 1]
            words, ends = _words(part := data[own[0] : own[-1]], own[1:] - own[0])
            # those that a row must have are found as often as there are rows
            if marks and any(part.tobytes().count(m.encode()) > (hi - lo if m in (marks[0], marks[1]) else 0) for m in marks):
                words, ends = _without(words, ends, marks)
            held.append((words, np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(words)) - 1))
            if sum(len(w) for w, _ in held) >= BLOCK:
                yield from blocks()
                held.clear()
    if held:
        yield from blocks()


def hashes(words: pa.Array) -> np.ndarray:
    """A hash of 32 bits for each word, and 0 at the end for none; it only deals grams to buckets."""
    offsets, data = _strings(words)
    if not len(words):
        return np.zeros(1, np.uint64)
    sizes = np.diff(offsets)
    powers = np.cumprod(np.full(sizes.max(), 0x9E3779B97F4A7C15, np.uint64))
    place = np.arange(len(data), dtype=np.int32) - np.repeat(offsets[:-1], sizes)
    h = np.add.reduceat((data + np.uint64(1)) * powers[place], offsets[:-1])
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return np.append(h >> np.uint64(32), np.uint64(0))


def deal(hashed: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each 64-bit number."""
    mixed = hashed * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def distinct(columns: list[np.ndarray], size: int, counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of ``columns`` (numbers below ``size``) in order, and the sum of their counts (of 1 each without ``counts``)."""
    bits = max(1, int(size - 1).bit_length())
    if counts is None and bits * len(columns) < 64:  # packed and sorted by themselves, which is faster
        key = columns[0].astype(np.int64)
        for c in columns[1:]:
            key <<= bits
            key |= c
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        sums = np.diff(first, append=len(key))
        key = key[first]
        return [((key >> bits * k) & ((1 << bits) - 1)).astype(np.int32) for k in range(len(columns) - 1, -1, -1)], sums
    key, bound = columns[0].astype(np.int64), int(size)
    for c in columns[1:]:
        if bound * size >= 1 << 63:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            bound = len(key)
        key = key * size + c
        bound *= int(size)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    counts = np.ones(len(key), np.int64) if counts is None else counts
    sums = np.add.reduceat(counts[order], first) if len(key) else counts
    order = order[first]
    return [c[order] for c in columns], sums


def runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where a run of equal rows begins."""
    n = len(columns[0])
    changes = np.zeros(n, bool)
    changes[:1] = True
    for c in columns:
        changes[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(changes)


_CODEC = pa.Codec("zstd", 1)


def raw(words: pa.Array) -> bytes:
    return _strings(words)[1].tobytes()


def narrow(c: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes each as the largest takes."""
    return c.astype(np.min_scalar_type(int(c.max()) if len(c) else 0))


def pack(words: bytes, columns: list[np.ndarray]) -> bytes:
    """Bytes of words (each with its space) and of columns of one length, which are ``narrow``."""
    body = words + b"".join([c.tobytes() for c in columns])
    return struct.pack(f"<3I{len(columns)}B", len(body), len(words), len(columns[0]), *(c.itemsize for c in columns)) + _CODEC.compress(body, asbytes=True)


def unpack(row: bytes, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    total, n_words, n, *sizes = struct.unpack_from(f"<3I{columns}B", row)
    body = np.frombuffer(_CODEC.decompress(row[12 + columns :], total), np.uint8)
    at, out = n_words, []
    for s in sizes:
        out.append(body[at : at + n * s].view(f"<u{s}") if s == 1 or at % s == 0 else np.frombuffer(body[at : at + n * s].tobytes(), f"<u{s}"))
        at += n * s
    return body[:n_words], out


def packed(bucket: np.ndarray, grams: list[np.ndarray], more: list[np.ndarray], words: pa.Array) -> Iterator[tuple[int, bytes]]:
    """(bucket, row) of each bucket's grams, which are numbers of ``words`` or, for none, ``len(words)``, and of ``more`` numbers beside them. In a
    row, words are numbered anew from 1, and 0 is none."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket, grams, more = bucket[order], np.stack([g[order] for g in grams]), [narrow(m[order]) for m in more]
    at = runs([bucket])
    scratch = np.zeros(len(words) + 1, np.int32)
    for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(bucket)]):
        numbers = grams[:, lo:hi].ravel()
        where = np.arange(len(numbers), dtype=np.int32)
        scratch[numbers] = where
        once = numbers[scratch[numbers] == where]
        once = np.sort(once[once < len(words)])
        scratch[len(words)] = 0
        scratch[once] = np.arange(1, len(once) + 1, dtype=np.int32)
        own = scratch[numbers].astype(np.min_scalar_type(len(once))).reshape(len(grams), -1)
        yield int(bucket[lo]), pack(raw(words.take(pa.array(once))), [*own, *(m[lo:hi] for m in more)])


def sent(rows: Iterable[tuple[int, bytes]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket and bytes as batches of a few megabytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def merged(rows: Iterable[bytes], grams: int, more: int) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
    """Rows of ``packed`` with one numbering: (distinct words, grams, more); a number of ``len(words)`` is none."""
    parts = [unpack(r, grams + more) for r in rows]
    empty = np.zeros(0, np.int64)
    if not parts:
        return pa.array([], pa.string()), [empty] * grams, [empty] * more
    words = cut(np.concatenate([w for w, _ in parts])).dictionary_encode()
    numbers, size, at, out = words.indices.to_numpy().astype(np.int32), len(words.dictionary), 0, []
    for w, columns in parts:
        n = int((w == 32).sum())
        own = np.concatenate((np.array([size], np.int32), numbers[at : at + n]))
        at += n
        out.append([own[c] for c in columns[:grams]])
    columns = [np.concatenate(c) for c in zip(*out)]
    rest = [np.concatenate([c[grams + k] for _, c in parts]).astype(np.int64) for k in range(more)]
    return words.dictionary, columns, rest


def bare(words: pa.Array) -> pa.Array:
    """The words without the space at their ends."""
    return pc.utf8_slice_codeunits(words, 0, -1)


def joined(words: pa.Array, grams: list[np.ndarray]) -> pa.Array:
    """The grams as strings, from ``bare`` words."""
    return pc.binary_join_element_wise(*(words.take(pa.array(g)) for g in grams), " ") if len(grams) > 1 else words.take(pa.array(grams[0]))
