"""Where intermediate tables go: the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder of our own only on a local master where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = tempfile.mkdtemp(prefix="voxloom-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _made.append(f"{shared_root(spark)}/voxloom-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: several later joins read it, and none of them computes it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete what this driver has written to the shared folder, from its ``since``-th path on, once no result that reads it
    is needed any more. How many paths there were; ``len_scratch()`` before a run gives its ``since``."""
    paths, jvm = _made[since:], spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    del _made[since:]
    return len(paths)


def len_scratch() -> int:
    return len(_made)


def bucketed(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Like ``kept``, in ``buckets`` buckets by ``key``: grouping by it needs no shuffle of these rows. Rows of a key should come together, as a task
    writes a file for each bucket that its rows fall in."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, and the frame knows them
    return out
