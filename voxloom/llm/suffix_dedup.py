"""Removal of byte strings of a given length that a document with a smaller id holds too.

Every string of 50 bytes is dealt by its minimiser, the smallest hash among its 20-byte strings: equal ones
have equal minimisers wherever they are. Neighbouring strings with one minimiser travel together, as
a stretch of text.

1. Within a block of documents, a stretch that a smaller document has byte by byte is removed, and one copy
   stays to stand for all. So a passage of very many documents gives one entry a block from here on.
   The entries go out as hashes (32 bits of the minimiser's, 80 bits of the content's), packed, and are counted by
   minimiser. A minimiser of one document only is done. A stretch whose whole content a smaller document of another
   block has, by both hashes, is removed. Of each other content that shares its minimiser with different ones, the stretch
   of its smallest document goes on to the next step.
2. These stretches are cut from the texts and dealt to shards by minimiser; those of a minimiser with very
   many contents (what comes before and after a very common line) by a hash of the bytes around it instead, which equal
   strings share as well. A shard's suffix array is made by induced sorting, and its permuted common
   prefixes tell which strings of 50 bytes are equal.
3. The removed stretches meet the texts again.

Texts travel compressed. The numbers of homes, buckets and shards follow from the bytes of all texts, and no step holds more
than one of these, or a block of documents, or one document.

Defined cases: null and empty texts have 0 bytes; documents shorter than the length lose nothing; rows with a
null id neither lose anything nor count as smaller ones; rows with equal ids don't remove from each other;
an empty table gives no rows; further columns are ignored; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import arrow_schema, dealt, groups_for, id_type, parted_batch, slices, stored, tidy
from .hashing import mix, piece_hashes, span_hashes, text_bytes
from .suffix_array import permuted_common_prefixes, suffix_array
from .words import pack_ints, unpack_ints

LENGTH, SEED = 50, 20
SHARDS = 4  # for each bucket of minimisers
HOME_BYTES = 16 << 20  # of text for each home, and for each bucket
CHUNK, CUT, BLOCK = 1 << 20, 2 << 20, 8 << 20
NEARLY = 4  # places of a minimiser within a string that are dealt together
HOT = 2048  # entries of a minimiser from which its strings are dealt by the bytes around it
STEP = 256 << 10  # bytes that are hashed at a time, whatever a block has
_LOW = np.uint64((1 << 32) - 1)  # of minimisers within a bucket, where two that agree only give the shards more to do


def _seeds(data: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the seed at each byte, and the smallest of those within the string of the full length from there."""
    at = np.arange(len(data) - seed + 1)
    seeds = least = span_hashes(data, at, at + seed)
    width, span = length - seed + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    return seeds, least


def stretches(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Of all rows: row, start, bytes, minimiser and both content hashes (64 and 16 bits) of each stretch, in text order. Rows are
    taken in turns of about ``STEP`` bytes: what is needed for each byte is many times the text."""
    out, lo = [], 0
    while lo < len(bounds) - 1:
        hi = min(max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + STEP, "right")) - 1), len(bounds) - 1)
        row, start, *rest = _stretches(data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], length, seed)
        out.append((row + lo, start + bounds[lo], *rest))
        lo = hi
    return tuple(map(np.concatenate, zip(*out))) if out else _stretches(data, bounds, length, seed)


def _stretches(data: np.ndarray, bounds: np.ndarray, length: int, seed: int):
    count = np.maximum(np.diff(bounds) - length + 1, 0)
    if not count.any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.uint16),)
    least = _seeds(data, length, seed)[1]
    at = np.repeat(bounds[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    row = np.repeat(np.arange(len(count)), count)
    value = least[at]
    first = np.flatnonzero(np.concatenate(([True], (value[1:] != value[:-1]) | (row[1:] != row[:-1]))))
    start, end = at[first], at[np.append(first[1:], len(at)) - 1] + length
    content, other = (piece_hashes(data, start, end, salt) for salt in (0, 1))
    return row[first], start, end - start, mix(value[first]), content, other.astype(np.uint16)


def parted(data: np.ndarray, start: np.ndarray, size: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Stretches, each of one minimiser, in parts: number of the stretch, start, bytes and key of each part. Strings
    whose minimiser is at nearly the same place within them are a part, and the key is the hash of the bytes that all these have, so
    that equal strings have equal keys, and what is around a common line tells its strings apart. The stretches are in text order."""
    out, i = [], 0
    while i < len(start):
        j = int(np.searchsorted(start, start[i] + STEP, "right"))
        low = start[i]
        owner, at, *rest = _parted(data[low : (start[i:j] + size[i:j]).max()], start[i:j] - low, size[i:j], length, seed)
        out.append((owner + i, at + low, *rest))
        i = j
    return tuple(map(np.concatenate, zip(*out)))


def _parted(data: np.ndarray, start: np.ndarray, size: np.ndarray, length: int, seed: int):
    n = size - length + 1
    owner = np.repeat(np.arange(len(start)), n)
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    seeds, least = _seeds(data, length, seed)
    width = length - seed + 1
    place = np.zeros(len(at), np.int64)  # the first of the smallest seeds
    for k in range(width - 1, -1, -1):
        place[seeds[at + k] == least[at]] = k
    low = place - place % NEARLY
    high = np.minimum(low + NEARLY, width) - 1
    key = mix(span_hashes(data, at + place - low, at + place - high + length) + low.astype(np.uint64))
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))))
    last = np.append(first[1:], len(at)) - 1
    return owner[first], at[first], at[last] + length - at[first], key[first]


def _pack_spans(key: np.ndarray, sub: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, bytes, bytes, bytes]:
    """Spans of documents as four columns: ids and subs once for each run of spans of a document, starts, and lengths
    with the numbers of spans of these runs."""
    first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]))))
    last = np.append(first[1:], len(key))
    return key[first].astype(np.int64).tobytes(), sub[first].astype(np.int32).tobytes(), pack_ints(start), pack_ints(np.concatenate((last - first, end - start)))


def _unpack_spans(table: pa.Table) -> tuple[np.ndarray, ...]:
    """The same, span by span: ids, subs, starts, ends; and the number of spans of each row."""
    out: list[list] = [[np.zeros(0, k)] for k in (np.int64, np.int32, np.int64, np.int64)]
    each = []
    for ids, subs, starts, rest in zip(*(table.column(c).to_pylist() for c in ("ids", "subs", "starts", "ends"))):
        key, sub, start, rest = np.frombuffer(ids, np.int64), np.frombuffer(subs, np.int32), unpack_ints(starts).astype(np.int64), unpack_ints(rest).astype(np.int64)
        count, size = rest[: len(key)], rest[len(key) :]
        for c, v in zip(out, (np.repeat(key, count), np.repeat(sub, count), start, start + size)):
            c.append(v)
        each.append(len(start))
    return *map(np.concatenate, out), np.array(each, np.int64)


def _bucket(minimiser: np.ndarray, parts: int) -> np.ndarray:
    return ((minimiser >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and ends of the runs of equal keys."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(keys))


def _batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _join(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(b, kind) for b in table.column(column).to_pylist() if b is not None)])


def numbered(docs: DataFrame, id_col: str, text_col: str, parts: int, keep: list[Column]) -> DataFrame:
    """(home, id, sub, text, extra): ``sub`` tells rows with one id apart, ``home`` deals documents out, and ``extra``
    holds the columns ``keep``, if there are any."""
    extra = [F.struct(*(c.alias(f"c{i}") for i, c in enumerate(keep))).alias("extra")] if keep else []
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *extra)
    sub = F.lit(0)
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        sub = F.row_number().over(W.partitionBy("id").orderBy(F.xxhash64("text"), "text"))
    home = F.pmod(F.coalesce(F.xxhash64("id"), F.lit(0)), F.lit(parts))
    return rows.select(home.cast("int").alias("home"), "id", sub.cast("int").alias("sub"), "text", *(["extra"] if keep else []))


# --- 1: hashes of stretches ---------------------------------------------------------------------------------

# rows of entries have a bucket; rows of removed stretches have starts and ends, and the number of their home as bucket
_HASHES = "bucket int, home int, homes binary, ids binary, subs binary, counts binary, minimisers binary, contents binary, others binary, starts binary, ends binary"
# rows of what is to go to the shards have tags; the others are removed stretches
_REPLY = "home int, ids binary, subs binary, counts binary, tags binary, kinds binary, starts binary, ends binary"


def _tags(minimiser: np.ndarray, content: np.ndarray, other: np.ndarray, key: np.ndarray, sub: np.ndarray) -> np.ndarray:
    """What a stretch of a document is asked for by."""
    return mix(mix(minimiser + mix(content + mix(other.astype(np.uint64)))) + key.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + sub.astype(np.uint64))


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches from a and from b are equal byte by byte."""
    if not len(a):
        return np.zeros(0, bool)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    differ = data[np.repeat(a, size) + within] != data[np.repeat(b, size) + within]
    return ~np.logical_or.reduceat(differ, np.cumsum(size) - size)


def _copies(data: np.ndarray, key: np.ndarray, sub: np.ndarray, start: np.ndarray, size: np.ndarray, minimiser: np.ndarray, content: np.ndarray):
    """Of a block's stretches: those that a smaller document of the block has byte by byte, and the others
    that stand for all, one of each document."""
    order = np.lexsort((sub, key, content, minimiser))
    m, c = minimiser[order], content[order]
    new = np.concatenate(([True], (m[1:] != m[:-1]) | (c[1:] != c[:-1])))
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.flatnonzero((key[order] > key[head]) & (size[order] == size[head]))
    lost = np.zeros(len(order), bool)
    for f in range(0, len(later), 1 << 13):
        part = later[f : f + (1 << 13)]
        lost[part] = _same_bytes(data, start[order[part]], start[head[part]], size[order[part]])
    rest, once = order[~lost], ~lost
    k, s = key[rest], sub[rest]
    again = np.concatenate(([False], (m[once][1:] == m[once][:-1]) & (c[once][1:] == c[once][:-1]) & (k[1:] == k[:-1]) & (s[1:] == s[:-1])))
    return np.sort(order[lost]), np.sort(rest[~again])


def _hash_blocks(parts: int):
    arrow = arrow_schema(_HASHES)

    def run(batches):
        held, size = [], 0

        def flush():
            home, key, sub = (np.concatenate([h[i] for h in held]) for i in range(3))
            rows = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
            bytes_ = np.cumsum([0] + [len(h[3]) for h in held[:-1]])
            data = np.concatenate([h[3] for h in held])
            base = np.concatenate([h[4][:-1] + b for h, b in zip(held, bytes_)])
            row = np.concatenate([h[5] + s for h, s in zip(held, rows)])
            start = np.concatenate([h[6] + b for h, b in zip(held, bytes_)])
            length, minimiser, content, other = (np.concatenate([h[i] for h in held]) for i in (7, 8, 9, 10))
            held.clear()
            columns: list[list] = [[] for _ in arrow.names]

            def add(**x):
                for c, name in zip(columns, arrow.names):
                    c.append(x.get(name))

            lost, kept = _copies(data, key[row], sub[row], start, length, minimiser, content)
            where = home[row[lost]]
            order = np.argsort(where, kind="stable")
            for f, e in zip(*_groups(where[order])):
                mine = lost[order[f:e]]
                who, at = row[mine], start[mine] - base[row[mine]]
                packed = dict(zip(("ids", "subs", "starts", "ends"), _pack_spans(key[who], sub[who], at, at + length[mine])))
                add(bucket=int(where[order[f]]), home=int(where[order[f]]), **packed)
            row, minimiser, content, other = row[kept], minimiser[kept], content[kept], other[kept]
            bucket = _bucket(minimiser, parts)
            order = np.argsort(bucket, kind="stable")
            for f, e in zip(*_groups(bucket[order])):
                mine = order[f:e]
                first, end = _groups(row[mine])
                who = row[mine][first]
                add(bucket=int(bucket[mine[0]]), homes=home[who].tobytes(), ids=key[who].tobytes(), subs=sub[who].tobytes(), counts=(end - first).astype(np.int32).tobytes(), minimisers=(minimiser[mine] & _LOW).astype(np.uint32).tobytes(), contents=content[mine].tobytes(), others=other[mine].tobytes())
            return _batch(columns, arrow)

        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            for i, j in slices(batch.column(3), CHUNK):
                part = batch.slice(i, j - i)
                data, bounds = text_bytes(part.column(3))
                held.append((*(np.asarray(part.column(k)) for k in range(3)), data.copy(), bounds, *stretches(data, bounds)))
                size += part.nbytes
                if size >= BLOCK:
                    yield from parted_batch(flush())
                    held, size = [], 0
        if held:
            yield from parted_batch(flush())

    return run


def _judge(parts: int):
    """What becomes of the entries of a bucket: a smaller document has the whole stretch (kind 0); or it goes to a shard, by
    minimiser (kind 1) or by the bytes around it (kind 2). Of equal contents only that of the smallest document does."""
    arrow = arrow_schema(_REPLY)

    def run(table: pa.Table) -> pa.Table:
        done = table.filter(pc.is_valid(table.column("home")))
        columns: list[list] = [done.column(name).to_pylist() if name in done.column_names else [None] * len(done) for name in arrow.names]
        table = table.filter(pc.is_null(table.column("home")))
        count = _join(table, "counts", np.int32)
        home, key, sub = (np.repeat(_join(table, c, k), count) for c, k in (("homes", np.int32), ("ids", np.int64), ("subs", np.int32)))
        minimiser = _join(table, "minimisers", np.uint32).astype(np.uint64)
        content, other = _join(table, "contents", np.uint64), _join(table, "others", np.uint16)
        order = np.argsort(minimiser, kind="stable")
        first, end = _groups(minimiser[order])
        if len(first):
            low, high = np.minimum.reduceat(key[order], first), np.maximum.reduceat(key[order], first)
            order = order[np.repeat(low != high, end - first)]  # minimisers of several documents
        if len(order):
            order = order[np.lexsort((other[order], content[order], minimiser[order]))]
            m, c, o, k = minimiser[order], content[order], other[order], key[order]
            new = np.concatenate(([True], (m[1:] != m[:-1]) | (c[1:] != c[:-1]) | (o[1:] != o[:-1])))
            least = np.minimum.reduceat(k, np.flatnonzero(new))[np.cumsum(new) - 1]
            first, end = _groups(m)
            contents = np.repeat(np.add.reduceat(new.astype(np.int64), first), end - first)
            kind = np.where(k > least, 0, np.where(contents > HOT, 2, np.where(contents > 1, 1, 3))).astype(np.uint8)
            order, kind = order[kind < 3], kind[kind < 3]
            again = np.argsort(home[order], kind="stable")
            order, kind = order[again], kind[again]
            tags = _tags(minimiser[order], content[order], other[order], key[order], sub[order])
            for f, e in zip(*_groups(home[order])):
                for column, v in zip(columns, (int(home[order[f]]), None, None, None, tags[f:e].tobytes(), kind[f:e].tobytes(), None, None)):
                    column.append(v)
        return pa.Table.from_batches([_batch(columns, arrow)], schema=arrow)

    return run


# --- texts, packed by home ----------------------------------------------------------------------------------

_TEXTS = "home int, ids binary, valid binary, subs binary, lengths binary, blob binary, extra binary"


def _pack_texts(parts: int):
    arrow = arrow_schema(_TEXTS)

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        held, size = [], 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            home = np.asarray(rows.column("home"))
            order = np.argsort(home, kind="stable")
            rows = rows.take(pa.array(order)).combine_chunks()
            home, ends = home[order], np.searchsorted(home[order], np.arange(parts + 1))
            columns: list[list] = [[] for _ in arrow.names]
            for h in np.unique(home).tolist():
                part = rows.slice(ends[h], ends[h + 1] - ends[h])
                data, bounds = text_bytes(part.column("text").chunk(0))
                valid = np.asarray(part.column("id").is_valid())
                ids = np.asarray(part.column("id").fill_null(0), np.int64)
                values = (h, ids.tobytes(), valid.tobytes(), np.asarray(part.column("sub"), np.int32).tobytes(), np.diff(bounds).tobytes(), squeeze(data.tobytes()), _to_bytes(part.column("extra").chunk(0)) if "extra" in part.column_names else None)
                for c, v in zip(columns, values):
                    c.append(v)
            return _batch(columns, arrow)

        for batch in batches:
            for i, j in slices(batch.column(3), CHUNK):
                part = batch.slice(i, j - i)
                held.append(part)
                size += part.nbytes
                if size >= BLOCK:
                    yield from parted_batch(flush())
                    held, size = [], 0
        if held:
            yield from parted_batch(flush())

    return run


def _to_bytes(rows: pa.StructArray) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("extra", rows.type)]), options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays([rows], ["extra"]))
    return sink.getvalue().to_pybytes()


def _from_bytes(b: bytes) -> pa.StructArray:
    return pa.ipc.open_stream(b).read_next_batch().column(0)


def _unpack_texts(table: pa.Table):
    """Row by row of the packed texts: ids, valid, subs, data, bounds, extra."""
    for ids, valid, subs, lengths, blob, extra in zip(*(table.column(c).to_pylist() for c in ("ids", "valid", "subs", "lengths", "blob", "extra"))):
        bounds = np.concatenate(([0], np.cumsum(np.frombuffer(lengths, np.int64))))
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8) if bounds[-1] else np.zeros(0, np.uint8)
        yield np.frombuffer(ids, np.int64), np.frombuffer(valid, bool), np.frombuffer(subs, np.int32), data, bounds, extra


def _in_parts(table: pa.Table, limit: int):
    """The same texts in parts of about ``limit`` bytes, whatever the rows that they came in: ids, valid, subs, data, bounds."""

    def joined(held: list):
        ids, valid, subs, data, sizes = (np.concatenate(c) for c in zip(*held))
        return ids, valid, subs, data, np.concatenate(([0], np.cumsum(sizes)))

    held, size = [], 0
    for ids, valid, subs, data, bounds, _ in _unpack_texts(table):
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit - size, "right")) - 1)
            held.append((ids[lo:hi], valid[lo:hi], subs[lo:hi], data[bounds[lo] : bounds[hi]], np.diff(bounds[lo : hi + 1])))
            size += int(bounds[hi] - bounds[lo])
            lo = hi
            if size >= limit:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


# --- 2: shards ----------------------------------------------------------------------------------------------

_CUT = "home int, ids binary, subs binary, starts binary, ends binary, shard int, blob binary"


def _cut(parts: int):
    """Removed stretches of a home's documents (shard -1), and the stretches that go to the shards."""
    arrow = arrow_schema(_CUT)

    def run(key, texts: pa.Table, replies: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in arrow.names]

        def add(*values):
            for c, v in zip(columns, (key[0].as_py(), *values)):
                c.append(v)

        done = replies.filter(pc.is_valid(replies.column("starts")))
        for row in zip(*(done.column(c).to_pylist() for c in ("ids", "subs", "starts", "ends"))):
            add(*row, -1, b"")
        tags, kinds = _join(replies, "tags", np.uint64), _join(replies, "kinds", np.uint8)
        order = np.argsort(tags, kind="stable")
        tags, kinds = tags[order], kinds[order]
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for part_ids, ok, part_subs, part, inner in _in_parts(texts, CUT) if len(tags) else ():
            row, start, size, minimiser, content, other = stretches(part, inner)
            own = _tags(minimiser & _LOW, content, other, part_ids[row], part_subs[row])
            at = np.minimum(np.searchsorted(tags, own), len(tags) - 1)
            asked = (tags[at] == own) & ok[row]
            kind = np.where(asked, kinds[at], 3)
            gone = np.flatnonzero(kind == 0)
            if len(gone):
                who, s = row[gone], start[gone] - inner[row[gone]]
                add(*_pack_spans(part_ids[who], part_subs[who], s, s + size[gone]), -1, b"")
            plain, hot = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
            shard = (_bucket(minimiser[plain], parts).astype(np.int64) * SHARDS + (minimiser[plain] % np.uint64(SHARDS)).astype(np.int64)).astype(np.int32)
            row_, start_, size_ = row[plain], start[plain], size[plain]
            if len(hot):
                nth, s, n, k = parted(part, start[hot], size[hot])
                who = row[hot][nth]
                # parts of a common passage are the same in very many documents: one stands for all of these
                lost, kept = _copies(part, part_ids[who], part_subs[who], s, n, k, span_hashes(part, s, s + n))
                if len(lost):
                    by = lost[np.argsort(who[lost], kind="stable")]
                    add(*_pack_spans(part_ids[who[by]], part_subs[who[by]], s[by] - inner[who[by]], s[by] - inner[who[by]] + n[by]), -1, b"")
                row_, start_, size_ = np.concatenate((row_, who[kept])), np.concatenate((start_, s[kept])), np.concatenate((size_, n[kept]))
                shard = np.concatenate((shard, (k[kept] % np.uint64(parts * SHARDS)).astype(np.int32)))
            again = np.argsort(shard, kind="stable")
            for f, e in zip(*_groups(shard[again])):
                mine = again[f:e]
                who, s, n = row_[mine], start_[mine], size_[mine]
                at = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
                s = s - inner[who]
                add(*_pack_spans(part_ids[who], part_subs[who], s, s + n), int(shard[mine[0]]), squeeze(part[at].tobytes()))
        return pa.Table.from_batches([_batch(columns, arrow)], schema=arrow)

    return run


_FOUND = "home int, ids binary, subs binary, starts binary, ends binary"


def _search():
    """The repeated strings of a shard, as stretches of the documents that lose them."""
    arrow = arrow_schema(_FOUND)

    def run(table: pa.Table) -> pa.Table:
        key, sub, start, end, each = _unpack_spans(table)
        home = np.repeat(np.asarray(table.column("home")), each)
        data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(b) for b in table.column("blob").to_pylist()), np.uint8)
        size = end - start
        base = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        # positions whose string of the full length lies within its stretch
        room = np.repeat(base + size, size) - np.arange(len(data)) >= LENGTH
        sa = suffix_array(data, LENGTH)
        sa = sa[room[sa]]
        first = np.flatnonzero(~permuted_common_prefixes(data, sa, LENGTH)[sa])
        low = np.repeat(np.minimum.reduceat(key[owner[sa]], first), np.diff(np.append(first, len(sa))))
        lost = np.sort(sa[key[owner[sa]] > low])
        if not len(lost):
            return pa.Table.from_batches([], schema=arrow)
        o = owner[lost]
        edge = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (lost[1:] > lost[:-1] + LENGTH))))
        last = np.append(edge[1:], len(lost)) - 1
        o = o[edge]
        f, t = lost[edge] - base[o] + start[o], lost[last] - base[o] + start[o] + LENGTH
        order = np.argsort(home[o], kind="stable")
        columns: list[list] = [[] for _ in arrow.names]
        for i, j in zip(*_groups(home[o][order])):
            mine = order[i:j]
            values = (int(home[o][mine[0]]), *_pack_spans(key[o][mine], sub[o][mine], f[mine], t[mine]))
            for c, v in zip(columns, values):
                c.append(v)
        return pa.Table.from_batches([_batch(columns, arrow)], schema=arrow)

    return run


# --- 3: removal ---------------------------------------------------------------------------------------------


def _spans(table: pa.Table):
    """A function that gives the kept bytes of a document and the number of its removed runs."""
    s_id, s_sub, s_from, s_to, _ = _unpack_spans(table)
    order = np.lexsort((s_from, s_sub, s_id))
    s_id, s_sub, s_from, s_to = s_id[order], s_sub[order], s_from[order], s_to[order]

    def kept(ids, valid, subs, data, bounds):
        left, right = np.searchsorted(s_id, ids), np.searchsorted(s_id, ids, "right")
        for r in range(len(ids)):
            text = data[bounds[r] : bounds[r + 1]]
            x = np.arange(left[r], right[r]) if valid[r] else left[:0]
            x = x[s_sub[x] == subs[r]]
            if len(x):
                change = np.bincount(s_from[x], minlength=len(text) + 1) - np.bincount(s_to[x], minlength=len(text) + 1)
                covered = np.cumsum(change)[: len(text)] > 0
                yield len(text), int(covered[0]) + int((covered[1:] & ~covered[:-1]).sum()), text[~covered].tobytes()
            else:
                yield len(text), 0, text.tobytes()

    return kept


def _removed(docs: DataFrame, finish, schema, id_col: str, text_col: str, keep: list[Column]) -> DataFrame:
    """``finish`` gets a group's rows of packed texts and the function of ``_spans``, and returns its output."""
    parts = groups_for(docs, text_col, HOME_BYTES)
    rows = numbered(docs, id_col, text_col, parts, keep)
    plain = rows.select("home", "id", "sub", "text")
    replies = dealt(plain.mapInArrow(tidy(_hash_blocks(parts)), _HASHES), "bucket", parts).groupBy("bucket").applyInArrow(tidy(_judge(parts)), _REPLY)
    asked = plain.mapInArrow(tidy(_pack_texts(parts)), _TEXTS)
    cut = stored(dealt(asked, "home", parts).groupBy("home").cogroup(dealt(replies, "home", parts).groupBy("home")).applyInArrow(tidy(_cut(parts)), _CUT), "stretches")
    found = dealt(cut.where("shard >= 0"), "shard", parts).groupBy("shard").applyInArrow(tidy(_search()), _FOUND)
    spans = cut.where("shard < 0").select(*arrow_schema(_FOUND).names).unionByName(found)
    texts = rows.mapInArrow(tidy(_pack_texts(parts)), _TEXTS)
    return dealt(texts, "home", parts).groupBy("home").cogroup(dealt(spans, "home", parts).groupBy("home")).applyInArrow(tidy(lambda key, t, s: finish(t, _spans(s))), schema)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    arrow = arrow_schema(schema)

    def finish(texts: pa.Table, kept) -> pa.Table:
        columns: list[list] = [[] for _ in arrow.names]
        for part in _unpack_texts(texts):
            for key, ok, (n, runs, left) in zip(part[0].tolist(), part[1].tolist(), kept(*part[:5])):
                for c, v in zip(columns, (key if ok else None, n, n - len(left), runs, hashlib.sha256(left).hexdigest())):
                    c.append(v)
        return pa.Table.from_batches([_batch(columns, arrow)], schema=arrow)

    return _removed(docs, finish, schema, id_col, text_col, []).withColumn("id", F.col("id").cast(id_type(docs, id_col)))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, the text without its removed bytes; what a removal leaves of a
    character in several bytes goes as well. A null text stays null."""
    schema = docs.schema
    arrow = arrow_schema(schema)
    # the text travels once: of its column only whether it was null goes with the others
    keep = [F.col(c).isNull() if c == text_col else F.col(c) for c in docs.columns]
    at = docs.columns.index(text_col)

    def finish(texts: pa.Table, kept) -> pa.Table:
        out = []
        for part in _unpack_texts(texts):
            columns = _from_bytes(part[5]).flatten()
            null = columns[at].to_pylist()
            columns[at] = pa.array([None if gone else left.decode("utf-8", "ignore") for gone, (_, _, left) in zip(null, kept(*part[:5]))], pa.string())
            out.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow))
        return pa.Table.from_batches(out, schema=arrow)

    return _removed(docs, finish, schema, id_col, text_col, keep)


def op5(docs: DataFrame) -> DataFrame:
    return measure(docs).withColumnRenamed("id", "doc_id")
