"""I-Match fingerprints with randomised lexicons.

The lexicon is the band of terms found in at least ``low`` and at most ``high`` of all documents: a band of
inverse document frequency that leaves out what nearly every text has and what only a few have. A
document keeps its distinct terms of the lexicon, in order; each of 64 randomised subsets of
the lexicon gives one hash of the terms that it keeps, and the fingerprint is all of them. Subsets are of
eight rates, from one term in 4 to one in 2048, so that for texts of any length some of them keep a
few terms; the share of equal hashes among these falls off smoothly as texts come apart.

The band is the same at every size. A term of the lexicon is in ``low`` of all documents at least, so there are no more of
them than mean distinct terms of a document / ``low``, whatever the number of documents: as 64-bit hashes, at 500 distinct
terms a document, 4 MB at most. That is what goes to the driver and, as a broadcast, to the executors.

Defined cases: null text is empty; equal texts have equal fingerprints; a text without a term of the lexicon
is fingerprinted by all its terms, one without terms has the fingerprint of zeros; equal fingerprints
are alike by 1, a fingerprint of zeros and another by 0; a null id sorts first; rows with equal
ids are in the order of their texts; repeated rows each give a row; the only document is its own
next one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_schema, id_type, keyed_text, n_parts, slices, tidy
from .hashing import mix, word_hashes

# a subset of rate r keeps one term in 2**r
RATES, EACH = (2, 4, 6, 7, 8, 9, 10, 11), 8
SUBSETS = len(RATES) * EACH
CHUNK, BLOCK = 1 << 20, 16 << 20


def _distinct(column: pa.Array) -> list[np.ndarray]:
    words, bounds = word_hashes(column)
    return [np.unique(words[i:j]) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def lexicon(docs: DataFrame, low: float = 0.001, high: float = 0.1, text_col: str = "text") -> np.ndarray:
    """The sorted hashes of the terms in the band, counted over all documents."""
    schema = "term bigint, df bigint"
    arrow = arrow_schema(schema)

    def count(batches):
        held, size = [], 0

        def flush():
            terms, df = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df.astype(np.int64))], schema=arrow)

        for batch in batches:
            for i, j in slices(batch.column(0), CHUNK):
                part = batch.column(0).slice(i, j - i)
                held += _distinct(part)
                size += part.nbytes
                if size >= BLOCK:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    n = docs.count()
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = texts.mapInArrow(tidy(count), schema).groupBy("term").agg(F.sum("df").alias("df"))
    band = counts.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n)))
    return np.sort(np.asarray(band.select("term").toArrow().column("term"), np.int64).view(np.uint64))


class Fingerprints:
    """Fingerprints of string columns for a lexicon."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms

    @staticmethod
    def _kept(terms: np.ndarray) -> np.ndarray:
        """Bit s of a row's 64 tells whether subset s keeps the term: if as many random bits as its rate are 0."""
        out = np.ones((len(terms), SUBSETS), bool)
        for s in range(SUBSETS):
            draw = mix(terms + np.uint64(0x51ED270B * (s + 1)))
            out[:, s] = draw & np.uint64((1 << RATES[s // EACH]) - 1) == 0
        return out

    def __call__(self, column: pa.Array) -> list[str]:
        sets = _distinct(column)
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        owner = np.repeat(np.arange(len(sets)), n)
        at = np.searchsorted(self.terms, flat)
        inside = (self.terms[np.minimum(at, len(self.terms) - 1)] == flat) if len(self.terms) else np.zeros(len(flat), bool)
        inside |= (np.bincount(owner[inside], minlength=len(sets)) == 0)[owner]
        flat, owner = flat[inside], owner[inside]
        unique, back = np.unique(flat, return_inverse=True)
        value = mix(unique)
        parts = np.zeros((len(sets), SUBSETS), np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
        if len(starts):
            kept = self._kept(unique)
            for s in range(SUBSETS):
                parts[owner[starts], s] = np.add.reduceat(np.where(kept[:, s], value, np.uint64(0))[back], starts)
        code = np.where(parts == 0, np.uint64(0), (mix(parts) >> np.uint64(48)) | np.uint64(1)).astype(">u2")
        return [row.tobytes().hex() for row in code]


def likeness(a: str, b: str) -> float:
    """The largest share of equal hashes in a rate of which half the subsets or more keep terms of either text;
    without such a rate, the share in all subsets that do."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2").reshape(-1, EACH) for s in (a, b))
    used = (x | y) > 0
    same, n = ((x == y) & used).sum(1), used.sum(1)
    full = n >= EACH // 2
    return float((same[full] / n[full]).max()) if full.any() else float(same.sum() / n.sum())


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, extra, id, text), in order of id within a part: each row's next one is the next row of its part;
    the row marked ``extra`` is only there as the next one of the row before it."""
    parts, kind = n_parts(docs.sparkSession), id_type(docs, id_col)
    keyed = keyed_text(docs, id_col, text_col)
    ranges = keyed.select("id").repartitionByRange(parts, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("id"), F.count("id").alias("n"), F.count("*").alias("rows"))
    # one row per partition, not per document; a null id sorts before all others
    found = ranges.orderBy("p").collect()
    nulls = any(r["n"] < r["rows"] for r in found)
    firsts = [r["id"] for r in found if r["id"] is not None]
    schema = f"part int, extra boolean, id {kind}, text string"
    arrow = arrow_schema(schema)
    last = max(len(firsts) - 1, 0)

    def deal(batches):
        import bisect

        for batch in batches:
            ids = batch.column(0).to_pylist()
            part = [0 if k is None else max(bisect.bisect_right(firsts, k) - 1, 0) for k in ids]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([False] * len(ids)), batch.column(0), batch.column(1)], schema=arrow)
            # the first row of all is the next one of the last row, the first of each part that of the part before
            heads = [i for i, (k, p) in enumerate(zip(ids, part)) if (k is None or k == firsts[p]) and (p > 0 or k is None or not nulls)]
            if heads:
                to = [part[i] - 1 if part[i] else last for i in heads]
                rows = batch.take(pa.array(heads, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([True] * len(heads)), rows.column(0), rows.column(1)], schema=arrow)

    return keyed.mapInArrow(deal, schema).repartition(parts, "part").sortWithinPartitions("part", "extra", "id", "text")


def fingerprint_pairs(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and the likenesses."""
    kind = id_type(docs, id_col)
    schema = f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    arrow = arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches):
        prints = Fingerprints(shared.value)
        before = None  # the last row so far, whose next one is still to come: part, id, text, fingerprint
        for whole in batches:
            for i, j in slices(whole.column(3), CHUNK):
                rows = whole.slice(i, j - i)
                part, extra, ids, texts = (c.to_pylist() for c in rows.columns)
                line = list(zip(part, extra, ids, texts, prints(rows.column(3))))
                if before is not None:
                    line = [before, *line]
                pairs = [(x, y) for x, y in zip(line, line[1:]) if not x[1] and x[0] == y[0]]
                before = line[-1]
                if pairs:
                    new = [edited(x[3], y[3]) for x, y in pairs]
                    other = prints(pa.array(new, pa.string()))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "id": [x[2] for x, _ in pairs],
                            "n_chars": [len(x[3]) for x, _ in pairs],
                            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
                            "fingerprint": [x[4] for x, _ in pairs],
                            "edited_fingerprint": other,
                            "near_edited": [likeness(x[4], f) for (x, _), f in zip(pairs, other)],
                            "near_next": [likeness(x[4], y[4]) for x, y in pairs],
                        },
                        schema=arrow,
                    )

    return with_next(docs, id_col, text_col).mapInArrow(tidy(run), schema)


def op4(docs: DataFrame) -> DataFrame:
    return fingerprint_pairs(docs, lexicon(docs)).withColumnRenamed("id", "doc_id")
