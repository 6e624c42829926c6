"""Connected components of an edge table, by hooking roots onto smaller roots and jumping pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stored


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); the root is the smallest node that can be reached."""
    e = stored(_pairs(edges), "edges")
    labels = stored(e.select(F.explode(F.array("lo", "hi")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while not e.isEmpty():
        parent = stored(e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("to")), "parent")
        while True:  # parents are smaller than their children, so there are no cycles
            up = parent.select(F.col("node").alias("to"), F.col("to").alias("up"))
            if parent.join(up, "to", "left_semi").isEmpty():
                break
            parent = stored(parent.join(up, "to", "left").select("node", F.coalesce("up", "to").alias("to")), "parent")
        labels = stored(labels.join(parent.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        for end in ("lo", "hi"):
            e = e.join(parent.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        e = stored(_pairs(e.select(F.col("lo").alias("a"), F.col("hi").alias("b"))), "edges")
    return labels
