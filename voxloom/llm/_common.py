"""Small helpers shared by the training-data operators: stored stages, bounded text chunks."""

from __future__ import annotations

import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="voxloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later jobs start from these
    files, so nothing is computed twice and a lost executor costs only its running tasks."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/voxloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """Like ``stored``, in ``parts`` buckets by ``key``: grouping by the key needs no further shuffle of these rows.
    A task writes a file for each bucket that its rows fall in, so rows of a key should come together."""
    spark = df.sparkSession
    table = f"voxloom_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(parts, key).option("path", f"{checkpoint_root(spark).rstrip('/')}/{table}").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, and the frame knows them
    return out


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sampled(hashed: Column, wanted: int, n: int) -> Column:
    """Whether a row is one of about ``wanted`` of ``n``, by a hash of it; the hash is cut as finely as so many rows need."""
    fine = max(1_000_000, n)
    return F.pmod(hashed, F.lit(fine).cast("bigint")) < min(fine, wanted * fine // max(n, 1))


def groups_for(docs: DataFrame, text_col: str, each: int) -> int:
    """How many groups of about ``each`` bytes the texts make: as many as there are shuffle partitions at least."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(n_parts(docs.sparkSession), -(-size // each))


def dealt(df: DataFrame, key: str, groups: int) -> DataFrame:
    """Dealt by ``key`` to as many partitions as there are groups, so that a task holds few groups however many there are."""
    return df.repartition(groups, key)


def tidy(run):
    """A worker's function that gives memory back to the system when it ends: workers stay for later tasks, and what one stage
    has needed is not to be kept through the next ones."""

    def release():
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    if inspect.isgeneratorfunction(run):

        def batches(rows):
            yield from run(rows)
            release()

        return batches

    if len(inspect.signature(run).parameters) == 1:  # as many parameters as Spark looks for

        def group(rows):
            out = run(rows)
            release()
            return out

        return group

    def groups(key, left, right):
        out = run(key, left, right)
        release()
        return out

    return groups


def parted_batch(batch: pa.RecordBatch, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``limit`` bytes, which is what the JVM holds of it at a time."""
    step = max(1, int(len(batch) * limit / max(batch.nbytes, 1)))
    for i in range(0, len(batch), step):
        yield batch.slice(i, step)


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty), under names of our own, so that other columns can't clash."""
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def id_type(df: DataFrame, id_col: str) -> str:
    return df.schema[id_col].dataType.simpleString()


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about ``limit`` bytes each, one row at least."""
    n = len(column)
    if n == 0:
        return
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(ddl) if not isinstance(ddl, T.StructType) else ddl)
