"""Byte-level BPE encoding and decoding over a distinct-word shuffle.

A text is cut into units of white space followed by other characters; no match of the split pattern
crosses from one unit to the next, so each distinct unit is encoded once, and the ids are put together
again by position. Decoding looks the ids up in the table of token bytes, which is as large as the
vocabulary and no larger whatever the corpus is.

Defined cases: null or empty text gives no ids and decodes to nothing; a null id stays null; repeated rows
each give a row; an empty table gives no rows; further columns are ignored; texts of any length are
encoded whole. Strings of special tokens in texts are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, id_type, slices
from .words import encoded, pack_ints, unpack_ints

# fixed values: the characters with the Unicode property White_Space
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


@functools.lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    def __init__(self, ranks: str, pattern: str):
        self.ranks, self.pattern = ranks, pattern

    def __call__(self):
        import tiktoken

        one = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=read_ranks(self.ranks), special_tokens={}).encode_ordinary
        return lambda words: [one(w.decode("utf-8", "surrogatepass")) for w in words]


def _pack(ids: list[list[int]]) -> bytes:
    lengths = pack_ints(np.fromiter(map(len, ids), np.uint32, len(ids)))
    return len(lengths).to_bytes(4, "little") + lengths + pack_ints(np.fromiter((x for y in ids for x in y), np.uint32))


def _documents(rows, results, ranked):
    """The ids of each document, as little-endian unsigned 32-bit integers."""
    lengths, ids = [], []
    for r in results:
        n = int.from_bytes(r[:4], "little")
        lengths.append(unpack_ints(r[4 : 4 + n]).astype(np.int64))
        ids.append(unpack_ints(r[4 + n :]))
    length = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
    blob = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    start = np.cumsum(length) - length
    length, start = length[ranked], start[ranked]
    for _, seq, _ in rows:
        s = unpack_ints(seq)
        n = length[s]
        at = np.arange(int(n.sum())) + np.repeat(start[s] - (np.cumsum(n) - n), n)
        yield blob[at].astype("<u4")


def _assembled(rows, results, ranked):
    ids = list(_documents(rows, results, ranked))
    return {"n_tokens": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]}


@functools.lru_cache(2)
def token_bytes(path: str) -> list[bytes]:
    """The table of token bytes, by id."""
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        table[i] = token
    return table


def decoded(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids.tolist()])


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids): ids as little-endian unsigned 32-bit integers, see ``as_array``."""
    return encoded(docs, id_col, text_col, _UNIT.findall, Encoder(ranks, pattern), _pack, _assembled, "n_tokens bigint, ids binary", name="bpe")


def as_array(df: DataFrame, column: str = "ids") -> DataFrame:
    """The packed ids as array<bigint>, with built-in functions."""
    h = F.hex(F.col(column))
    ids = F.transform(
        F.sequence(F.lit(0), F.greatest(F.length(column) / 4 - 1, F.lit(0)).cast("int")),
        lambda i: F.conv(F.concat(*(F.substring(h, i * 8 + k, F.lit(2)) for k in (7, 5, 3, 1))), 16, 10).cast("bigint"),
    )
    return df.withColumn(column, F.when(F.length(column) == 0, F.array().cast("array<bigint>")).otherwise(ids))


def decode(df: DataFrame, ranks: str, id_col: str = "id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, decoded): the bytes of packed ids."""
    kind = id_type(df, id_col)
    more = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in keep)
    schema = f"id {kind}, {more}decoded binary"
    arrow = arrow_schema(schema)

    def run(batches):
        table = token_bytes(ranks)
        for whole in batches:
            for i, j in slices(whole.column(whole.num_columns - 1), 4 << 20):
                batch = whole.slice(i, j - i)
                text = [decoded(np.frombuffer(b or b"", "<u4"), table) for b in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.binary())], schema=arrow)

    return df.select(F.col(id_col).alias("id"), *keep, F.col(ids_col).alias("ids")).mapInArrow(run, schema)


def op7(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Encoding and decoding in one pass over the assembled ids, of which only digests are returned."""

    def digests(rows, results, ranked):
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for ids in _documents(rows, results, ranked):
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded(ids, token_bytes(ranks))).hexdigest())
        return out

    columns = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return encoded(docs, "doc_id", "text", _UNIT.findall, Encoder(ranks, pattern), _pack, digests, columns, name="bpe").withColumnRenamed("id", "doc_id")
