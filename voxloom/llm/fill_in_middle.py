"""Fill-in-middle transformation: a document's middle is moved behind its suffix, at cuts that an indexable skip list finds.

A text is cut into units (white space with the word after it; white space at the end). Two ranks, drawn from a hash of the
id, part it into prefix, middle and suffix. The code-point offsets of both ranks come from the row's skip list
(``skip_list``); cutting and joining are DataFrame functions. The result is ``plain`` (the text itself), ``psm`` (prefix,
suffix, middle) or ``spm`` (suffix, prefix, middle).

Defined cases: null text is empty; an empty text, and one that holds a mark, is plain, so marks of the output are always
the template's own; a null id draws as the empty string; repeated rows and ids give a row each, with equal draws for equal
ids; an empty table gives no rows; further columns are ignored; a text of white space is one unit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import keyed_text, slices
from .skip_list import SkipLists, unit_widths

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text whose lists are held at a time; a longer text is alone.
CHUNK = 2 << 20


def draw(id_col: Column, seed: int, k: int) -> Column:
    """The k-th draw (from 1) of 32 bits for an id: a group of eight digits of a hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _cut(text: Column, first: Column, second: Column) -> Column:
    """struct(n, a, b): units of the text, and the code points before the smaller and the larger of both draws modulo n + 1."""

    @F.arrow_udf("n long, a long, b long")
    def cut(texts: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        parts = []
        for i, j in slices(texts, CHUNK):
            lists = SkipLists(*unit_widths(texts.slice(i, j - i)))
            row, n = np.arange(j - i), lists.counts.astype(np.int64)
            p, q = (c.slice(i, j - i).to_numpy(zero_copy_only=False) % (n + 1) for c in (x, y))
            parts.append((n, lists.offsets(row, np.minimum(p, q)), lists.offsets(row, np.maximum(p, q))))
        n, a, b = (np.concatenate(c) for c in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 3
        return pa.StructArray.from_arrays([pa.array(n), pa.array(a), pa.array(b)], ["n", "a", "b"])

    return cut(text, first, second)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", moved: int = 50, suffix_first: int = 80, seed: int = 42) -> DataFrame:
    """(id, text, n, form, prefix_chars, middle_chars, output): ``moved`` of a hundred texts are transformed, ``suffix_first``
    of a hundred of these in the form ``spm``."""
    rows = keyed_text(docs, id_col, text_col)
    at = lambda k: draw(F.col("id"), seed, k)
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (at(3) % 100 >= moved)
    form = F.when(plain, "plain").when(at(4) % 100 < suffix_first, "spm").otherwise("psm")
    cut = rows.select("id", "text", form.alias("form"), _cut(F.col("text"), at(1), at(2)).alias("c"))
    a, b = F.col("c.a").cast("int"), F.col("c.b").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.lit(0x7FFFFFFF))
    moved_text = {
        "psm": F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle),
        "spm": F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle),
    }
    kept = lambda c: F.when(F.col("form") != "plain", c)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", moved_text["spm"]).otherwise(moved_text["psm"])
    return cut.select("id", "text", F.col("c.n").alias("n"), "form", kept(F.col("c.a")).alias("prefix_chars"), kept(F.col("c.b") - F.col("c.a")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text, rebuilt from the transformed one and its form: no part holds a mark, so the marks part it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op13(docs: DataFrame) -> DataFrame:
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(docs).select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
