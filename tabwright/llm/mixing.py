"""Mixing sources to target weights with exact budgets.

Rows get hash-random keys, are sorted by them inside ranges of each source, and prefix sums of the sizes over
the ranges tell where a source's budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_below, name, saved, text_or_empty, unfold, whole_rows, words

MOST_EPOCHS, ROWS_PER_RANGE, MOST_RANGES, SEED = 3, 1000, 100_000, "mix-1"


def random_key(*parts: Column) -> Column:
    """32 hex digits that depend on the seed and the parts alone."""
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def targets(sizes: DataFrame, weights=(1, 2, 3), most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Per source (columns ``source``, ``source_size``, ``rows``) its ``target`` and whole ``budget``.

    The sources in the order of their code points, null last, take the weights in turn and share the sum of all
    sizes. A target stops at ``most_epochs`` times its source's size; the excess is shared again by weight
    until none is above. Every round is one sum over the table of sources, and the level that it leaves is two
    numbers, so any number of sources will do. The numbering of sources is one sorted pass over that table.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), ((F.col("place") - 1) % n + 1).cast("int"))
    numbered = sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", weight)
    numbered = saved(numbered.withColumn("most", most_epochs * F.col("source_size")), "mix-sources")
    total = numbered.agg(F.sum("source_size")).head()[0] or 0
    level = (0, 1)

    def full(at):
        return F.col("most").cast("decimal(38,0)") * at[1] < F.lit(at[0]).cast("decimal(38,0)") * F.col("weight")

    while True:  # the level only rises, and a source that is full stays full, so this ends
        taken, shares = numbered.agg(F.sum(F.when(full(level), F.col("most"))), F.sum(F.when(~full(level), F.col("weight")))).head()
        new = (total - int(taken or 0), int(shares or 0))
        if not new[1] or new == level:
            break
        level = new
    over, under = F.lit(level[0]).cast("bigint"), F.lit(level[1]).cast("bigint")
    share = (over * F.col("weight")).cast("double") / under.cast("double")
    whole = F.expr(f"({level[0]}L * weight) div {level[1]}L")
    return numbered.withColumn("target", F.when(full(level), F.col("most").cast("double")).otherwise(share)).withColumn(
        "budget", F.when(full(level), F.col("most")).otherwise(whole))


def _taken(df: DataFrame, source: str, key: str, text: str, weights, most_epochs: int, rows_per_range: int, carry: bool) -> DataFrame:
    """Rows with ``id size source_size target epochs cut``, and the whole ``row`` if it is to be carried."""
    crc = F.crc32(text_or_empty(text).cast("binary"))
    narrow = df.select(name(key).alias("id"), name(source).cast("string").alias("source"),
                       F.size(words(text_or_empty(text))).cast("bigint").alias("size"), crc.alias("crc"),
                       *[whole_rows(df).alias("row")] * carry)
    narrow = saved(narrow.withColumn("key", random_key(F.col("id"), F.when(F.col("id").isNull(), F.col("crc")))), "mix-sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    aims = saved(targets(sizes, weights, most_epochs), "mix-targets")
    rows = aims.agg(F.sum("rows")).head()[0] or 0
    per_range = max(rows_per_range, rows // MOST_RANGES)
    aims = broadcast_below(aims.select(F.col("source").alias("s"), "place", "source_size", "rows", "target", "budget"))
    share_of_keys = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    dealt = narrow.join(aims, F.col("source").eqNullSafe(F.col("s"))).withColumn(
        "range", F.floor(share_of_keys * F.ceil(F.col("rows") / per_range)))
    sums = dealt.groupBy("place", "range").agg(F.sum("size").alias("in_range"))
    earlier = W.partitionBy("place").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(F.col("place").alias("p"), F.col("range").alias("r"),
                         F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("start"))
    inside = W.partitionBy("place", "range").orderBy("key", "id", "size", "crc").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = dealt.join(starts, (F.col("place") == F.col("p")) & (F.col("range") == F.col("r")))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div nullif(source_size, 0)")).otherwise(F.lit(0).cast("bigint"))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size")
    cut = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), rest - F.col("before")))
    return placed.withColumn("before", before).withColumn("epochs", epochs).withColumn("cut", cut)


def mix(df: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", weights=(1, 2, 3),
        most_epochs: int = MOST_EPOCHS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per document: ``key``, ``size`` (words), ``source_size``, ``target`` and ``taken``.

    A source whose budget is above its size is repeated whole as often as it fits, and the rest of the budget
    is cut from one more pass over its documents in the order of their random keys: the last document of the cut
    is taken in part, so that the words taken are exactly the whole part of the target. Rows that agree in key and
    text are alike; their order does not matter.

    Keys are uniform, so equal ranges of the key hold about ``rows_per_range`` rows of any source, however large
    it is (the ranges grow once there would be more than 100,000 of them). Only numbers are shuffled. A null text
    has size 0, and null is a source of its own. An empty table gives an empty table.
    """
    made = _taken(df, source, key, text, weights, most_epochs, rows_per_range, False)
    taken = F.col("epochs") * F.col("size") + F.col("cut")
    return made.select(F.col("id").alias(key), "size", "source_size", "target", taken.alias("taken"))


def mixed_rows(df: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", weights=(1, 2, 3),
               most_epochs: int = MOST_EPOCHS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """The mix itself, with the columns of the frame: every document as often as it is taken whole, and the one
    at its source's cut with the words that are taken of it (joined by spaces).

    Documents without words hold nothing to take and stay out. Whole rows are shuffled once.
    """
    made = _taken(df, source, key, text, weights, most_epochs, rows_per_range, True)
    whole = F.col("epochs") + F.when((F.col("cut") > 0) & (F.col("cut") == F.col("size")), 1).otherwise(0)
    part = F.when((F.col("cut") > 0) & (F.col("cut") < F.col("size")), F.array(F.col("cut")))
    takes = F.concat(F.array_repeat(F.col("size"), whole.cast("int")), F.coalesce(part, F.array().cast("array<bigint>")))
    rows = made.where("size > 0").select("row", "size", F.explode(takes).alias("take"))
    kept = F.col("row")[text]
    cut = F.array_join(F.slice(words(kept.cast("string")), 1, F.col("take").cast("int")), " ")
    return rows.select(*[F.when(F.col("take") < F.col("size"), cut).otherwise(kept).alias(c) if c == text
                         else F.col("row")[c].alias(c) for c in df.columns])
