"""Best-fit decreasing packing of documents into sequences of bounded length.

Which bin a piece goes to depends on its length alone, so the packing is planned on the histogram of
lengths, which has no more rows than a sequence has tokens, whatever the corpus is. The plan is exactly
that of best-fit decreasing, longest pieces first, each into the tightest open bin; a segment tree over
the remaining capacities finds that bin in logarithmic time. Bins of the same remaining capacity are
kept as runs of sequence numbers, and a run takes all the pieces of a length that it can at once. Every
piece then finds its place from its rank among the pieces of its length.

Defined cases: null or empty text is a document with no ids but the closing one; a null id stays null;
repeated rows are documents of their own; an empty table gives no rows; further columns are ignored;
documents longer than a sequence, and only those, are cut.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import arrow_schema, id_type, keyed_text, slices, stored, tidy
from .hashing import LOWER, SPACE, edges, span_hashes, text_bytes

#: Words that a Python worker keeps the ids of, and ids kept for them, at most: 60 MB of arrays.
CACHE_WORDS, CACHE_IDS = 1 << 20, 5 << 20
CHUNK = 1 << 20
SLOTS = 1 << 21
LONG = 512  # bytes from which a word is told by a cryptographic hash
# classes of bytes: letters, digits, the apostrophe, other marks
_CLASS = np.full(256, 3, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = 0
_CLASS[48:58] = 1
_CLASS[39] = 2
# neighbours between which the tokenizer always cuts; an apostrophe may go with the letters or marks after it
_CUTS = np.array([[0, 1, 1, 1], [1, 1, 1, 1], [0, 1, 0, 0], [1, 1, 0, 0]], bool)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts, which of them are one printable piece, and the bytes, in lower case where that is
    safe. Words are parted by ASCII white space, and those of ASCII and the letters from À to ÿ also between
    letters, marks and single digits."""
    gap = SPACE[data]
    kind, lower, other = _CLASS[data], LOWER[data], data >= 128
    lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    kind[lead] = kind[lead + 1] = 0
    other[lead] = other[lead + 1] = False
    upper = lead[data[lead + 1] < 0x9F] + 1
    lower[upper] = data[upper] + 0x20
    split = _CUTS[kind[:-1], kind[1:]]
    if other.any():  # words with other characters stay whole and as they are
        start, end = edges(gap, bounds)
        wide = np.concatenate(([0], np.cumsum(other)))
        mixed = wide[end] > wide[start]
        at, size = start[mixed], (end - start)[mixed]
        inside = np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())
        lower[inside] = data[inside]
        split[inside[inside < len(split)]] = False
    start, end = edges(gap, bounds, split)
    odd = np.concatenate(([0], np.cumsum(other | (data < 33) | (data == 127) | (kind == 2))))
    return start, end, odd[end] == odd[start], lower


class WordIds:
    """Ids of texts for a tokenizer that drops white space, cuts between letters, digits and marks, and lower-cases.
    Words are told by 64-bit hashes (those of ``LONG`` bytes or more by a cryptographic one). Ids of words seen
    before lie in one buffer of fixed size, found by a table of slots; a word may be displaced by another one, and when
    the buffer is full only words that were met again stay. A text with one of the tokenizer's special strings
    goes to the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # the model without normalising, for words that are one piece; pieces end in tokens with the model's suffix
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix or "\0"
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        probes = [*map(chr, range(33, 127)), *map(chr, range(0xE0, 0xF7)), "the", "tokenization", "zqxj" * 9, "?!", "...", "élèveß"]
        probes = [w for w in probes if w == w.lower() and w != "'"]
        ids, sizes = self._simple(probes)
        alone = self.tokenizer.encode_batch_fast(probes, add_special_tokens=False)
        if len(sizes) != len(probes) or any(e.ids != x.tolist() for e, x in zip(alone, np.split(ids, np.cumsum(sizes)[:-1]))):
            self.bare = None
        self.keys, self.starts, self.sizes = np.zeros(CACHE_WORDS, np.uint64), np.zeros(CACHE_WORDS, np.int32), np.zeros(CACHE_WORDS, np.int32)
        self.met = np.zeros(CACHE_WORDS, bool)
        self.ids = np.zeros(CACHE_IDS, np.uint32)
        self.slots = np.zeros(SLOTS, np.int32)
        self.n, self.n_ids = 1, 0  # entry 0 stands for no word

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key & np.uint64(SLOTS - 1)).astype(np.int64)

    def _gather(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of entries, one after the other, and how many each has."""
        n = self.sizes[entry].astype(np.int64)
        at = np.repeat(self.starts[entry] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return self.ids[at], n

    def _clear(self) -> None:
        """Keep the words that were met again, if they are fewer than half."""
        kept = np.flatnonzero(self.met[: self.n])
        if len(kept) > CACHE_WORDS // 2 or int(self.sizes[kept].sum()) > CACHE_IDS // 2:
            kept = kept[:0]
        ids, sizes = self._gather(kept)
        self.keys[1 : len(kept) + 1] = self.keys[kept]
        self.n, self.n_ids = 1, 0
        self.met[:] = False
        self.slots[:] = 0
        self._add(self.keys[1 : len(kept) + 1].copy(), ids, sizes)

    def _add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        entry = np.arange(self.n, self.n + len(keys))
        self.keys[entry], self.sizes[entry] = keys, sizes
        self.starts[entry] = self.n_ids + np.cumsum(sizes) - sizes
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_ids = self.n + len(keys), self.n_ids + len(ids)
        self.slots[self._slot(keys)] = entry
        return entry

    def _simple(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of words that are one piece each: many at a time, told apart where a piece ends."""
        groups = [" ".join(words[i : i + 1024]) for i in range(0, len(words), 1024)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(groups, add_special_tokens=False))])
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def _any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter((x for y in ids for x in y), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _encoded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, simple: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and where each text's ids end."""
        h = span_hashes(data, start, end)
        for i in np.flatnonzero(end - start >= LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        entry = self.slots[self._slot(h)].astype(np.int64)
        entry[self.keys[entry] != h] = 0
        self.met[entry] = True
        new = np.flatnonzero(entry == 0)
        kinds = []
        if len(new):
            key, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            at = new[first]
            raw = data.tobytes()
            for mine, encode in ((simple[at], self._simple), (~simple[at], self._any)):
                where = np.flatnonzero(mine)
                ids, sizes = encode([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[at[where]].tolist(), end[at[where]].tolist())])
                kinds.append((where, ids, sizes))
            sizes = np.zeros(len(key), np.int64)
            for where, _, n in kinds:
                sizes[where] = n
            if self.n + len(key) <= CACHE_WORDS and self.n_ids + int(sizes.sum()) <= CACHE_IDS:
                own = np.zeros(len(key), np.int64)
                for where, ids, n in kinds:
                    own[where] = self._add(key[where], ids, n)
                entry[new] = own[back]
            else:
                return self._uncached(entry, new, back, kinds, sizes, bounds, start)
        ids, n = self._gather(entry)
        return ids, np.concatenate(([0], np.cumsum(n)))[np.searchsorted(start, bounds)]

    def _uncached(self, entry, new, back, kinds, sizes, bounds, start) -> tuple[np.ndarray, np.ndarray]:
        """The same when new words have no room: from the buffer and a buffer of their own."""
        begins = np.zeros(len(sizes), np.int64)
        at = self.n_ids
        for where, ids, n in kinds:
            begins[where] = at + np.cumsum(n) - n
            at += len(ids)
        both = np.concatenate([self.ids[: self.n_ids], *(ids for _, ids, _ in kinds)])
        n, begin = self.sizes[entry].astype(np.int64), self.starts[entry].astype(np.int64)
        n[new], begin[new] = sizes[back], begins[back]
        self._clear()
        ids = both[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return ids, np.concatenate(([0], np.cumsum(n)))[np.searchsorted(start, bounds)]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        whole = np.zeros(len(texts), bool)
        for s in self.special:
            whole |= np.asarray(pc.match_substring(texts, s))
        out: list = [None] * len(texts)
        if whole.any():
            for i in np.flatnonzero(whole).tolist():
                out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            texts = pc.if_else(pa.array(whole), "", texts)
        data, bounds = text_bytes(texts)
        if not len(data):
            return [np.zeros(0, np.uint32) if x is None else x for x in out]
        start, end, simple, data = words(data, bounds)
        ids, ends = self._encoded(data, start, end, simple if self.bare is not None else np.zeros(len(start), bool), bounds)
        ends = ends.tolist()
        return [ids[ends[i] : ends[i + 1]] if x is None else x for i, x in enumerate(out)]


@functools.lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, crc32, part, rank): the pieces of each document; ``rank`` counts the
    pieces of one length in one stored part. Stored, as ranks hold for this one run only."""
    kind = id_type(docs, id_col)
    schema = f"id {kind}, piece int, start bigint, length int, crc32 bigint, part int, rank bigint"
    arrow = arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        part, seen, close = TaskContext.get().partitionId(), Counter(), np.array([end_id], "<u4").tobytes()
        encode = word_ids(tokenizer)
        for batch in batches:
            for i, j in slices(batch.column(1), CHUNK):
                rows: list[list] = [[] for _ in arrow.names]
                for key, own in zip(batch.column(0).slice(i, j - i).to_pylist(), encode(batch.column(1).slice(i, j - i))):
                    ids = own.astype("<u4").tobytes() + close
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        n = len(piece) // 4
                        for column, v in zip(rows, (key, k, at // 4, n, zlib.crc32(piece), part, seen[n])):
                            column.append(v)
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, arrow)], schema=arrow)

    return stored(keyed_text(docs, id_col, text_col).mapInArrow(tidy(run), schema), "pieces")


class Capacities:
    """Segment tree over remaining capacities 0..n: the smallest one of at least x that has open bins."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, i: int, value: bool) -> None:
        i += self.size
        self.any[i] = value
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def at_least(self, x: int) -> int | None:
        i = x + self.size
        if self.any[i]:
            return x
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on {length: count}: rows (length, first rank, count, first sequence, pieces per
    sequence, offset of the first piece). At most a few rows per length."""
    tree, free, rows, sequences = Capacities(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if not free.setdefault(room, []):
                tree.set(room, True)
            free[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.at_least(length)
            if room is None:
                room, each = capacity, capacity // length
                first, bins = sequences, -(-left // each)
                sequences += bins
            else:
                each = room // length
                first, bins = free[room].pop()
                if not free[room]:
                    tree.set(room, False)
            full = min(bins, left // each)
            if full:
                rows.append((length, rank, full * each, first, each, capacity - room))
                put(room - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            if left and full < bins:  # the last bin of this length takes the fewer pieces that are left
                rows.append((length, rank, left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                full, left, rank = full + 1, 0, rank + left
            put(room, first + full, bins - full)
    return rows


def pack(p: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to the stored ``pieces``."""
    spark = p.sparkSession
    by_part = p.groupBy("part", "length").agg(F.count("*").alias("n"))
    # ranks go on from part to part; one length's rows here are one per part
    bases = stored(by_part.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).fillna(0, ["base"]), "bases")
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = np.array(plan(histogram, capacity), np.int64).reshape(-1, 6)
    kind = id_type(p, "id")
    schema = f"id {kind}, piece int, start bigint, length int, crc32 bigint, sequence_id bigint, offset bigint"
    arrow = arrow_schema(schema)
    big = np.int64(1) << 40  # ranks are smaller

    def place(batches):
        t = table[np.lexsort((table[:, 1], table[:, 0]))]
        keys = t[:, 0] * big + t[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c)), np.int64) for c in ("length", "at"))
            row = t[np.searchsorted(keys, length * big + rank, "right") - 1] if len(length) else t[:0]
            nth = rank - row[:, 1]
            each = np.maximum(row[:, 4], 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(row[:, 3] + nth // each), pa.array(row[:, 5] + nth % each * length)], schema=arrow)

    # the bases grow with the corpus, so they are joined by a shuffle, not broadcast
    placed = p.join(bases.select("part", "length", "base").hint("merge"), ["part", "length"]).select("id", "piece", "start", "length", "crc32", (F.col("rank") + F.col("base")).alias("at"))
    return placed.mapInArrow(place, schema)


def op8(docs: DataFrame, tokenizer: str) -> DataFrame:
    out = pack(pieces(docs, tokenizer))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", F.col("length").cast("bigint").alias("length"), F.col("crc32").alias("ids_crc32"), "sequence_id", "offset")
