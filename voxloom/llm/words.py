"""Encode each distinct word of a corpus once, and bring the results back to the documents.

Texts are cut into words that a tokenizer treats independently of each other. Documents are gathered in
blocks of bounded size; a block is stored as its vocabulary (the distinct words, dealt to buckets by a
hash) and its documents as sequences of word numbers. The vocabularies of all blocks are shuffled by
bucket, where each distinct word is encoded once; the answers go back to their blocks and meet the
sequences there. What is shuffled is the blocks' vocabularies, a small part of the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, bucketed, groups_for, id_type, keyed_text, slices, tidy

BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 32 << 20  # of text for each bucket of words: their number follows the corpus, so a bucket's distinct words are bounded
LEVEL = 3


def pack_ints(x: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, byte planes apart, compressed."""
    return zstandard.ZstdCompressor(level=LEVEL).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_ints(b: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(b)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_words(words: list[bytes]) -> bytes:
    lengths = pack_ints(np.fromiter(map(len, words), np.uint32, len(words)))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(words))


def unpack_words(b: bytes) -> list[bytes]:
    n = int.from_bytes(b[:4], "little")
    ends = np.cumsum(unpack_ints(b[4 : 4 + n]).astype(np.int64))
    blob = zstandard.ZstdDecompressor().decompress(b[4 + n :])
    return [blob[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _blocks(split: Callable[[str], list[str]], buckets: int, counts_only: bool, schema: pa.Schema):
    """Arrow batches of (id, text) to rows of blocks: one with ``vocab`` per bucket, one with ``seq`` per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        numbers: dict[str, int] = {}
        held: list = []
        size = 0

        def flush():
            nonlocal block, numbers, held, size
            words = [w.encode("utf-8", "surrogatepass") for w in numbers]
            by_word = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))[by_word]
            dealt = np.argsort(bucket, kind="stable")
            order, ends = by_word[dealt], np.searchsorted(bucket[dealt], np.arange(buckets + 1))
            place = np.empty(len(words), np.int64)  # where a word is, bucket by bucket
            place[order] = np.arange(len(words))
            # frequent words get small numbers, which take little room in the sequences
            met = np.bincount(np.concatenate([ids for _, ids, _ in held]), minlength=len(words))
            ranked = np.argsort(-met, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[ranked] = np.arange(len(words))
            rows: dict[str, list] = {k: [] for k in schema.names}

            def add(**x):
                for k, v in rows.items():
                    v.append(x.get(k))

            for k in range(buckets):
                if ends[k] < ends[k + 1]:
                    add(block=block, bucket=k, vocab=pack_words([words[i] for i in order[ends[k] : ends[k + 1]].tolist()]))
            add(block=block, bucket=-2, seq=pack_ints(place[ranked]))
            for key, ids, n_bytes in held:
                seq = rank[ids]
                if counts_only:
                    seq, freq = np.unique(seq, return_counts=True)
                    add(block=block, bucket=-1, id=key, n_bytes=n_bytes, seq=pack_ints(np.diff(seq, prepend=0)), freq=pack_ints(freq))
                else:
                    add(block=block, bucket=-1, id=key, n_bytes=n_bytes, seq=pack_ints(seq))
            block, numbers, held, size = block + 1, {}, [], 0
            return pa.RecordBatch.from_pydict(rows, schema=schema)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, j in slices(batch.column(1), BLOCK_BYTES // 4):
                for key, text in zip(ids[i:j], batch.column(1).slice(i, j - i).to_pylist()):
                    words = split(text)
                    get = numbers.setdefault
                    held.append((key, np.fromiter((get(w, len(numbers)) for w in words), np.int32, len(words)), n := len(text.encode())))
                    size += n
                    if size >= BLOCK_BYTES:
                        yield flush()
        if held:
            yield flush()

    return run


def encoded(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    split: Callable[[str], list[str]],
    encoder: Callable[[], Callable[[list[bytes]], list]],
    pack: Callable[[list], bytes],
    finish: Callable[[Iterator[tuple], list[bytes], np.ndarray], dict],
    out: str,
    counts_only: bool = False,
    name: str = "words",
) -> DataFrame:
    """``split`` cuts a text; ``encoder()`` gives a function from distinct words to results; ``pack`` makes
    the results of a vocabulary bytes; ``finish`` gets a block's documents (n_bytes, seq, freq), the
    packed results in bucket order and where in these each word number is, and returns the columns ``out``."""
    kind = id_type(docs, id_col)
    schema = f"block bigint, bucket int, id {kind}, n_bytes bigint, seq binary, freq binary, vocab binary"
    arrow = arrow_schema(schema)
    parts = groups_for(docs, text_col, BUCKET_BYTES)
    blocks = bucketed(keyed_text(docs, id_col, text_col).mapInArrow(tidy(_blocks(split, parts, counts_only, arrow)), schema), "block", parts, name)
    vocab = blocks.where(F.col("bucket") >= 0).select("block", "bucket", "vocab").repartition(parts, "bucket")

    def encode(batches):
        known: dict[bytes, object] = {}
        run = encoder()
        for batch in batches:
            for block, bucket, packed in zip(*(c.to_pylist() for c in batch.columns)):
                words = unpack_words(packed)
                new = [w for w in words if w not in known]
                if new:
                    known.update(zip(new, run(new)))
                yield pa.RecordBatch.from_pydict({"block": [block], "bucket": [bucket], "result": [pack([known[w] for w in words])]}, schema=replies)

    replies = arrow_schema("block bigint, bucket int, result binary")
    answers = vocab.mapInArrow(tidy(encode), "block bigint, bucket int, result binary")
    final = arrow_schema(f"id {kind}, {out}")

    def assemble(key, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")
        order, left = left.filter(pc.equal(left.column("bucket"), -2)), left.filter(pc.equal(left.column("bucket"), -1))
        rows = zip(*(left.column(c).to_pylist() for c in ("n_bytes", "seq", "freq")))
        ranked = unpack_ints(order.column("seq")[0].as_py()).astype(np.int64)
        return pa.Table.from_pydict({"id": left.column("id"), **finish(rows, right.column("result").to_pylist(), ranked)}, schema=final)

    own = blocks.where(F.col("bucket") < 0).select("block", "bucket", "id", "n_bytes", "seq", "freq")
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assemble, f"id {kind}, {out}")
