"""Token counts: each distinct pre-token is counted once, and a document's count is the sum over its
pre-token frequencies; ids are never made.

Right for vocabularies in which no piece goes on after a non-space with a space, so that text may be cut
before each run of spaces (the word-mark character counts as a space); that is checked when a model is loaded.

Defined cases: null or empty text has 0 tokens and 0 bytes; a null id stays null; repeated rows each give
a row; an empty table gives no rows; further columns are ignored. Texts of any length are counted whole.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import encoded, pack_ints, unpack_ints

MARK = "▁"
_UNIT = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")


def pre_tokens(text: str) -> list[str]:
    """The words of a text, its dummy prefix included, in order."""
    return _UNIT.findall(" " + text) if text else []


class PieceCounter:
    """Counts the pieces of words that begin with the dummy prefix or a space of the text."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = model
        one = sentencepiece.SentencePieceProcessor(model_file=model)
        across = [p for p in map(one.id_to_piece, range(one.get_piece_size())) if MARK in p.lstrip(MARK)]
        if across:
            raise ValueError(f"pieces go on after a word with a space, so words can't be counted alone: {across[:3]}")

    def __call__(self):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=self.model)

        def counts(words: list[bytes]) -> list[int]:
            # the library puts a dummy prefix before a text: hand over the word without one space
            texts = [w.decode("utf-8", "surrogatepass").replace(MARK, " ") for w in words]
            bare = [t[1:] if t.startswith(" ") else t for t in texts]
            return [len(x) if b else int(t == " ") for x, b, t in zip(encode.encode(bare, num_threads=1), bare, texts)]

        return counts


def _sums(rows, results, ranked):
    table = np.concatenate([unpack_ints(r) for r in results]) if results else np.zeros(0, np.uint32)
    table = table[ranked]
    out: dict[str, list] = {"n_bytes": [], "n_tokens": []}
    for n_bytes, seq, freq in rows:
        ids = np.cumsum(unpack_ints(seq).astype(np.int64))
        out["n_bytes"].append(n_bytes)
        out["n_tokens"].append(int((table[ids].astype(np.int64) * unpack_ints(freq)).sum()))
    return out


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) per row of ``docs`` for a sentencepiece model file that all executors can read."""
    return encoded(docs, id_col, text_col, pre_tokens, PieceCounter(model), lambda x: pack_ints(np.array(x, np.uint32)), _sums, "n_bytes bigint, n_tokens bigint", counts_only=True, name="counts")


def op6(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    return token_counts(docs, model).select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
