"""Periodic run detection in the words of documents, by block convolution at dyadic scales.

A run is a stretch of words with smallest period q, of four periods and six words at least, that no neighbouring word
extends. At scale L, the words are cut into blocks of L. For each block, an exact transform (``number_transform``) gives the
sum of squared differences to the following window at each distance from L to 2L - 1, and the zeros are the block's
occurrences there. Any run with a period of these lengths holds two neighbouring blocks that occur again at that distance;
such distances are seeds. A seed is compared word by word to both sides until the period breaks, which gives the run.

All documents of a batch are one sequence: words are numbered document by document, so that words of two documents never
agree. Blocks without any chance are not transformed: those with a word that doesn't come again within the window, and those
whose window lies inside a run of a smaller period. Neither can belong to a run of this scale. The sums are exact modulo a
prime: no zero is missed, and a sum that happens to be a multiple of it fails the comparison of words.

Defined cases: null text has no words; a text of white space has none; repeated rows and ids give a row each; an empty table
gives no rows; further columns are ignored; overlapping runs are all given. One document's words are one task's memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, id_type, keyed_text, parted_batch, slices, tidy
from .number_transform import PRIME, correlate

#: A run has so many periods and words at least; the seeds rely on four.
PERIODS, LEAST = 4, 6
#: Bytes of text whose words are held at a time; a longer text is alone.
CHUNK = 2 << 20
#: Numbers in a matrix of transforms.
_CELLS = 1 << 19
_P = np.uint64(PRIME)


def _next_distance(x: np.ndarray) -> np.ndarray:
    """How far each word's next occurrence is; a number beyond all for the last one."""
    out = np.full(len(x), 1 << 62, np.int64)
    order = np.argsort(x, kind="stable")
    again = x[order][1:] == x[order][:-1]
    out[order[:-1][again]] = np.diff(order)[again]
    return out


def _zeros(x: np.ndarray, blocks: np.ndarray, size: int) -> np.ndarray:
    """[block, k]: is the sum of squared differences between the block and the words ``size + k`` further on zero?"""
    at = blocks[:, None] * size
    short = x[at + np.arange(size)]
    window = x[at + size + np.arange(2 * size - 1)]
    squares = np.zeros((len(blocks), 2 * size), np.uint64)
    np.cumsum(window * window % _P, axis=1, out=squares[:, 1:])
    total = (short * short % _P).sum(axis=1, dtype=np.uint64)[:, None] + squares[:, size:] - squares[:, :size]
    return (total + np.uint64(2) * (_P - correlate(short, window))) % _P == 0


def _seeds(x: np.ndarray, blocks: np.ndarray, size: int):
    """(distance, start) of neighbouring blocks that both occur again at that distance."""
    step = max(1, _CELLS // (2 * size))
    for i in range(0, len(blocks) - 1, step):
        some = blocks[i : i + step + 1]  # each chunk shares a block with the next
        zero = _zeros(x, some, size)
        row, k = np.nonzero(zero[:-1] & zero[1:] & (np.diff(some) == 1)[:, None])
        yield np.stack((k + size, some[row] * size), axis=1)


def _agree(x: np.ndarray, at: int, d: int, to: int, forward: bool) -> int:
    """The first place from ``at`` on (backward: the last place before it, plus one) where the words d apart differ."""
    step = 64
    while at != to:
        if forward:
            end = min(at + step, to)
            differ = x[at:end] != x[at + d : end + d]
            if differ.any():
                return at + int(differ.argmax())
        else:
            end = max(at - step, to)
            differ = (x[end:at] != x[end + d : at + d])[::-1]
            if differ.any():
                return at - int(differ.argmax())
        at, step = end, step * 2
    return at


def find_runs(x: np.ndarray, longest: int) -> np.ndarray:
    """(start, end, period) of all runs of a sequence of non-negative numbers, in order of start and period. No run is
    longer than ``longest``."""
    found: dict[tuple[int, int], int] = {}
    n, size = len(x), 1
    if n < LEAST:
        return np.zeros((0, 3), np.int64)
    reach = _next_distance(x)
    while PERIODS * size <= longest:
        live = reach < 2 * size
        if found:
            starts, ends = np.array(sorted(found), np.int64).T
            ends = np.maximum.accumulate(ends)
            begin = np.arange(len(live)) * size
            at = np.searchsorted(starts, begin, "right") - 1
            live &= (at < 0) | (ends[at] < begin + 3 * size - 1)
        pair = live[:-1] & live[1:]
        blocks = np.flatnonzero(np.concatenate((pair, [False])) | np.concatenate(([False], pair)))
        if len(blocks):
            # behind the end stands a number that no word has
            padded = np.concatenate((x, np.full(3 * size, x.max() + 1))).astype(np.uint64)
            seeds = np.concatenate(list(_seeds(padded, blocks, size)))
            done = (0, 0)
            for d, s in seeds[np.lexsort((seeds[:, 1], seeds[:, 0]))].tolist():
                if done[0] == d and s < done[1]:
                    continue
                end = _agree(x, s, d, n - d, True)
                done = (d, end)
                if end < s + 2 * size:  # a sum that the prime divides by chance
                    continue
                start = _agree(x, s, d, 0, False)
                if end + d - start >= max(LEAST, PERIODS * d):
                    found.setdefault((start, end + d), d)
        even = len(reach) // 2 * 2
        reach, size = np.maximum(reach[:even:2], reach[1:even:2]), size * 2
    out = np.array([(a, b, d) for (a, b), d in found.items()], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _numbers(rows: list[list[bytes]]) -> np.ndarray:
    """Words of all rows as numbers that are equal for equal words of one row only."""
    out, base = [], 0
    for words in rows:
        number: dict[bytes, int] = {}
        out.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) + base)
        base += len(number)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed): each row's runs in order of start and period, and its words without the repetitions,
    joined by one space: a word goes if any run has it after the run's first period."""
    schema = f"id {id_type(docs, id_col)}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    arrow = arrow_schema(schema)

    def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
        if not len(runs):
            return b" ".join(words)
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
        np.add.at(drop, runs[:, 1], -1)
        return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0)])

    def run(batches):
        for whole in batches:
            texts = whole.column(1).cast(pa.binary())
            for i, j in slices(whole.column(1), CHUNK):
                rows = [t.split() for t in texts.slice(i, j - i).to_pylist()]  # of bytes: at the six ASCII white spaces
                count = np.array([len(w) for w in rows], np.int64)
                bounds = np.concatenate(([0], np.cumsum(count)))
                runs = find_runs(_numbers(rows), int(count.max()))
                ends = np.searchsorted(runs[:, 0], bounds)
                runs[:, :2] -= np.repeat(bounds[:-1], np.diff(ends))[:, None]
                text = [collapsed(w, runs[a:b]) for w, a, b in zip(rows, ends, ends[1:])]
                lists = pa.StructArray.from_arrays([pa.array(runs[:, 0]), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])], fields=list(arrow.field("runs").type.value_type))
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists).cast(arrow.field("runs").type)
                out = pa.RecordBatch.from_arrays([whole.column(0).slice(i, j - i), pa.array(count), found, pa.array(text, pa.binary()).cast(pa.string())], schema=arrow)
                yield from parted_batch(out)

    return keyed_text(docs, id_col, text_col).mapInArrow(tidy(run), schema)


def with_repeats(id_col: Column, text: Column) -> Column:
    """The text, or for a tenth of the ids its words with a repeated stretch, as the contract of the query has it."""
    h = F.crc32(id_col.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(cycle, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def op12(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = periodic_runs(docs.select("doc_id", with_repeats(F.col("doc_id"), text).alias("text")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    rows = found.select("id", "runs", "collapsed", best.alias("best"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
