"""Connected components of a table of links, as rounds of joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stable import stable


def _smallest(pairs: DataFrame) -> DataFrame:
    """Per node ``u`` the smallest of itself and its neighbours."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))


def components(links: DataFrame, most_rounds: int = 60, keep: Callable[[DataFrame], DataFrame] = stable) -> DataFrame:
    """``node`` and ``root`` (the smallest node it can reach) for every node of ``links`` (columns ``a``, ``b``).

    Rounds of large-star (larger neighbours hang on the smallest neighbour) and small-star (the smaller ones too)
    turn every component into a star, in a number of rounds that grows with the logarithm of its size. A
    neighbourhood is only ever reduced to its minimum, so nothing gathers it, and hot nodes of the joins can be
    split. Every round is a table written by ``keep``.
    """
    def fixed(pairs: DataFrame) -> DataFrame:
        return keep(pairs.where("u <> v").distinct())

    edges = fixed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = fixed(both.join(_smallest(both), F.col("u") == F.col("k")).where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")))
        # every row now points from a node to a smaller one
        met = large.join(_smallest(large), F.col("u") == F.col("k"))
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = fixed(met.select(F.explode(pairs).alias("e")).select("e.u", "e.v"))
        # stars: every node has one parent, and no parent has one
        parents = edges.select(F.col("v").alias("u")).distinct().withColumn("n", F.lit(1))
        several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if edges.select("u").distinct().join(parents, "u", "left_semi").select("u").unionByName(
                several.select("u")).limit(1).count() == 0:
            found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    raise RuntimeError("the components did not settle")
