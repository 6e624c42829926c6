"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Vectors become binary codes: the signs of their coordinates after centring and several rotations, each learned to bring the
vectors near the corners of a cube; eight bits for each coordinate. A code is split into substrings of 16 bits.
By the pigeonhole principle two codes within Hamming distance r, split in m substrings, differ in one of these by at most
the threshold of its table, where the thresholds add up to r - m + 1; so looking up all substrings that near to
a query's in the tables of substrings finds every code within r. Whole codes are compared next, and those within r are
ranked by the exact distance of the original vectors.

Rows are dealt to blocks of bounded size, each with its own tables, so no value of a substring, however frequent, makes a
task larger than a block. The stated queries are held against all blocks, which give back only their nearest. A
query with fewer than ``k`` codes within the radius, counted over all blocks, is asked again with every code in the radius: what
is found doesn't depend on how rows are dealt.

The rotations and the radius are fitted on about ``fit_rows`` vectors at most: the radius is the smallest
one within which the wanted share of true neighbours lies, measured by brute force on that sample.
Every row is indexed.

Defined cases: vectors that are null, zero, of another length than most, or that hold a null or a
non-finite component take no part; rows with a null id take no part; ties in distance go to the smaller
id; a query's own row is no candidate, other rows with equal vectors are; rows repeated with id and vector
count once; without candidates a query has no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._common import arrow_schema, n_parts, sampled, stored, tidy

ROTATIONS = 8  # bits for each coordinate
BLOCK_ROWS = 1 << 16
PROBED, WORTH = 8, 0.25  # queries of a block on which the tables are tried, and the share of rows that they may leave


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the rows that take part, vectors in double precision."""
    v = F.col("v")
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull()
        & v.isNotNull()
        & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
        & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    )


class Codes:
    """Centring and learned rotations to binary codes of whole 16-bit words."""

    def __init__(self, x: np.ndarray, rounds: int = 30, seed: int = 7):
        self.mean = x.mean(0)
        centred, width = x - self.mean, x.shape[1]
        axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]
        bits = max(16, -(-width // 16) * 16)
        maps = []
        for k in range(ROTATIONS):
            draw = np.random.default_rng((seed, k))
            # widths that are no multiple of 16 are filled up with random directions
            own = np.column_stack([axes, draw.normal(size=(width, bits - width))]) if bits > width else axes
            z = centred @ own
            rotation = np.linalg.qr(draw.normal(size=(bits, bits)))[0]
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(z.T @ np.where(z @ rotation >= 0, 1.0, -1.0))
                rotation = u @ vt
            maps.append(own @ rotation)
        self.map = np.column_stack(maps)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The substrings of each vector's code, 16 bits each."""
        return np.packbits((x - self.mean) @ self.map >= 0, axis=1).view(np.uint16)


def hamming(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(1, dtype=np.int64)


def _words(codes: np.ndarray) -> np.ndarray:
    """Codes as whole 64-bit words, filled up with zeros."""
    return np.ascontiguousarray(np.pad(codes, [*[(0, 0)] * (codes.ndim - 1), (0, -codes.shape[-1] % 4)])).view(np.uint64)


class Tables:
    """The tables of substrings of one block: the values that occur, and the rows of each."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.words = codes, _words(codes)
        self.order = [np.argsort(c, kind="stable") for c in codes.T]
        self.values, self.counts = zip(*(np.unique(c, return_counts=True) for c in codes.T))

    def _near(self, code: np.ndarray, radius: int):
        """For each table, which of its values are within its threshold; the thresholds add up to radius - m + 1."""
        m = len(code)
        low, more = divmod(max(radius - m + 1, -m), m)
        for t in range(m):
            yield t, np.bitwise_count(self.values[t] ^ code[t]) <= low + (t < more)

    def prune(self, codes: np.ndarray, radius: int) -> bool:
        """Whether the tables leave few of the rows to be compared, told from the first of the queries."""
        left = [self._hit(code, radius).mean() for code in codes[:PROBED]]
        return bool(left) and float(np.mean(left)) < WORTH

    def _hit(self, code: np.ndarray, radius: int) -> np.ndarray:
        hit = np.zeros(len(self.codes), bool)
        for t, near in self._near(code, radius):
            hit[self.order[t][np.repeat(near, self.counts[t])]] = True
        return hit

    def within(self, code: np.ndarray, radius: int, prune: bool = True) -> np.ndarray:
        """All rows whose code is within the radius: looked up in every table, checked on whole codes. Where the tables leave
        most rows, whole codes are one table, which gives the same rows sooner."""
        word = _words(code)
        if not prune:
            return np.flatnonzero(np.bitwise_count(self.words ^ word).sum(1, dtype=np.uint16) <= radius)
        rows = np.flatnonzero(self._hit(code, radius))
        return rows[np.bitwise_count(self.words[rows] ^ word).sum(1, dtype=np.uint16) <= radius]


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(1))


def fit(vectors: DataFrame, k: int, recall: float, fit_rows: int = 20_000, probes: int = 200) -> tuple[Codes, int] | None:
    """The codes and the radius, from a sample by a hash of the id."""
    sample = vectors.where(sampled(F.xxhash64("id"), fit_rows, vectors.count())).select("id", "v").toPandas().sort_values("id")
    if sample.empty:
        return None
    width = sample.v.map(len).mode()[0]
    x = np.stack(sample.v[sample.v.map(len) == width].to_numpy())
    codes = Codes(x)
    own = codes(x)
    step = max(1, len(x) // probes)
    radii = []
    for i in range(0, len(x), step):
        d = _distances(x, x[i])
        d[i] = np.inf
        best = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        radii += hamming(own[best], own[i]).tolist()
    return codes, int(np.quantile(radii, recall, method="higher")) if radii else 0


def search(rows: DataFrame, queries: Column, k: int = 10, recall: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows found for each row of ``queries``, a condition on ``id``."""
    spark = rows.sparkSession
    vectors = usable(rows, id_col, vector_col)
    none = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    fitted = fit(vectors, k, recall, fit_rows)
    if fitted is None:
        return none
    codes, radius = fitted
    width = len(codes.mean)
    vectors = vectors.where(F.size("v") == width)
    blocks = max(n_parts(spark), -(-vectors.count() // BLOCK_ROWS))
    out = "query_id bigint, vec_id bigint, score double"
    arrow = arrow_schema(out)

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        return np.asarray(flat.flatten(), np.float64).reshape(-1, width)

    def nearest(radius: int):
        def run(table: pa.Table) -> pa.Table:
            """The nearest of a block for each query, of those within the radius."""
            is_query = np.asarray(table.column("query"))
            ids, x = np.asarray(table.column("id"), np.int64), matrix(table.column("v"))
            q_ids, q = ids[is_query], x[is_query]
            ids, x = ids[~is_query], x[~is_query]
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            found = ([], [], [])
            if len(ids) and len(q_ids):
                tables = Tables(codes(x))
                asked = codes(q)
                prune = tables.prune(asked, radius)
                for query, v, code in zip(q_ids.tolist(), q, asked):
                    near = tables.within(code, radius, prune)
                    near = near[ids[near] != query]
                    d = _distances(x[near], v)
                    if len(d) > k:
                        cut = np.partition(d, k - 1)[k - 1]
                        near, d = near[d <= cut], d[d <= cut]
                    best = np.lexsort((ids[near], d))[:k]
                    for column, values in zip(found, ([query] * len(best), ids[near[best]].tolist(), d[best].tolist())):
                        column.extend(values)
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(found, arrow)], schema=arrow)

        return tidy(run)

    dealt = vectors.distinct().select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("query"), "id", "v")

    def asked(own: DataFrame, radius: int, name: str) -> DataFrame:
        to_all = own.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("query"), "id", "v")
        return stored(dealt.unionByName(to_all).repartition(blocks, "block").groupBy("block").applyInArrow(nearest(radius), out), name)

    own = vectors.where(queries).distinct()
    first = asked(own, radius, "near")
    enough = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = own.join(enough, "id", "left_anti")
    parts = first if short.isEmpty() else first.join(enough, F.col("query_id") == F.col("id"), "left_semi").unionByName(asked(short, codes.map.shape[1], "rest"))
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = parts.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op3(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("id") % 100 == 0)
