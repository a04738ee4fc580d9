"""Exact quantiles without gathering any group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import col
from .running import running_count


def quantiles(df: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float],
              weight: str | None = None) -> DataFrame:
    """One row per group: the group columns, ``count`` and ``quantiles`` (linear interpolation).

    Equal values are counted first; each value's rank comes from `running_count`, which spreads any group over
    all tasks.
    """
    keys = [col(g) for g in groups]
    n = F.sum(col(weight)) if weight else F.count(F.lit(1))
    counted = (df.filter(col(value).isNotNull()).groupBy(*keys, col(value).cast("double").alias("_v"))
               .agg(n.alias("_n")))
    ranked = running_count(counted, groups, "_v", "_n")
    first, last = F.col("_before"), F.col("_before") + F.col("_n")
    picks, lerp, wanted = [], [], []
    for i, share in enumerate(shares):
        spot = (F.col("_total") - 1) * F.lit(float(share))
        for name, rank in ((f"_lo{i}", F.floor(spot)), (f"_hi{i}", F.ceil(spot))):
            holds = (first <= rank) & (rank < last)
            wanted.append(holds)
            picks.append(F.max(F.when(holds, F.col("_v"))).alias(name))
        lerp.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (spot - F.floor(spot)))
    found = ranked.filter(reduce(lambda x, y: x | y, wanted)).groupBy(*keys, "_total").agg(*picks)
    return found.select(*keys, F.col("_total").alias("count"), F.array(*lerp).alias("quantiles"))
