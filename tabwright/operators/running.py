"""Running counts inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import col
from .stable import stable


def running_count(df: DataFrame, groups: Sequence[str], order_by: str, weight: str | None = None) -> DataFrame:
    """Add ``_before`` (summed weight of the group's earlier rows) and ``_total`` (of the whole group).

    The rows are range-sorted by (group, order) over all tasks. A row's place is its place inside its
    partition plus the group's size in earlier partitions, so even one group holding most of the data is
    spread evenly. ``order_by`` must be unique within a group for a definite result.
    """
    keys = [col(g) for g in groups]
    w = col(weight) if weight else F.lit(1).cast("bigint")
    placed = stable(df.orderBy(*keys, col(order_by)).withColumn("_part", F.spark_partition_id()))
    pieces = placed.groupBy(*keys, "_part").agg(F.sum(w).alias("_size"))
    # a group has at most one piece per partition, so these windows stay small
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.select(*[col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_piece"),
                           F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"),
                           F.sum("_size").over(W.partitionBy(*keys)).alias("_total"))
    same: Column = reduce(lambda x, y: x & y, [col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)],
                          F.col("_part") == F.col("_piece"))
    inside = W.partitionBy("_part", *keys).orderBy(col(order_by)).rowsBetween(W.unboundedPreceding, -1)
    return (placed.withColumn("_inside", F.coalesce(F.sum(w).over(inside), F.lit(0))).join(pieces, same)
            .select(*[col(c) for c in df.columns], (F.col("_start") + F.col("_inside")).alias("_before"), "_total"))
