"""Order over all rows, or over one very long group, without a window that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.storage import kept


def ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds ``_range``: rows are dealt by sampled ranges of the order, so that neither outliers nor gaps make one range large,
    and stored with the number of their range. Rows of equal order have one range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running_sums(rows: DataFrame, order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """Adds ``<c>_before`` for each of ``sums``: its sum over the rows that come before; values of ``order`` are distinct.
    Sums go over the ranges (a row each) first and then within each range."""
    by = F.desc(order) if descending else F.asc(order)
    placed = ranged(rows, by)
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # over one row for each range
    bases = placed.groupBy("_range").agg(*(F.sum(c).alias(c) for c in sums)).select("_range", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}_base") for c in sums))
    within = W.partitionBy("_range").orderBy(by).rowsBetween(W.unboundedPreceding, -1)
    out = placed.join(bases, "_range")
    return out.select(*rows.columns, *((F.col(f"_{c}_base") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"{c}_before") for c in sums))


def nearest_marks(rows: DataFrame, group: str, order: str, mark: Column) -> DataFrame:
    """Adds ``before`` and ``after``: the last ``order`` at which ``mark`` holds up to each row, and the first from it on, within
    its group. A group may have any share of the rows: it is cut into ranges, each of which knows the last mark of
    the ranges before it and the first of those after it, and both windows inside a range only grow."""
    placed = ranged(rows.withColumn("_at", F.when(mark, F.col(order))), F.asc(group), F.asc(order))
    ends = placed.groupBy(group, "_range").agg(F.max("_at").alias("_last"), F.min("_at").alias("_first"))
    there = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range of the group
    back = W.partitionBy(group).orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(F.col(group).alias("_group"), F.col("_range").alias("_own"), F.max("_last").over(there).alias("_earlier"), F.min("_first").over(back).alias("_later"))
    inside = W.partitionBy(group, "_range")
    up = F.max("_at").over(inside.orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow))
    down = F.min("_at").over(inside.orderBy(F.desc(order)).rangeBetween(W.unboundedPreceding, W.currentRow))
    near = placed.withColumn("before", up).withColumn("after", down)
    both = near.join(carried, near[group].eqNullSafe(F.col("_group")) & (near["_range"] == F.col("_own")), "left")
    return both.select(*rows.columns, F.coalesce("before", "_earlier").alias("before"), F.coalesce("after", "_later").alias("after"))
