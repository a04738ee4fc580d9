"""What each of several filters removes in every order in which they could be applied."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import name, saved, text_or_empty

FILTERS = "ABCDE"
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, "#$%&*|"
#: Orders of so many filters are listed at most (5,040 orders).
MOST_FILTERS = 7


def own_failures(text: Column) -> Column:
    """``digest`` (SHA-256) of each text and ``mask`` of the filters A to D that it fails on its own (A is bit 0), in Arrow batches.

    A: under 200 words; B: under 50 % distinct words; C: over 2 % capitals A-Z; D: holds one of ``#$%&*|``.
    """
    @pandas_udf("digest binary, mask int")
    def of(texts):
        import hashlib

        import pandas as pd
        capitals, signs = bytes(range(65, 91)), SIGNS.encode()
        made = []
        for t in texts:
            held = t.encode("utf-8", "surrogatepass")
            words = held.split()                     # of bytes: at the space and the controls 9 to 13 alone
            n = len(words)
            fails = (n < FEWEST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * n,
                     100 * (len(held) - len(held.translate(None, capitals))) > MOST_CAPITALS * len(t),
                     len(held.translate(None, signs)) < len(held))
            made.append((hashlib.sha256(held).digest(), sum(bit << k for k, bit in enumerate(fails))))
        return pd.DataFrame(made, columns=["digest", "mask"])
    return of(text)


def masked(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part mask n good toxic``: documents of each part by the set of filters they fail, with E as bit 4.

    E: the text is that of a smaller key anywhere in the table. Only digests are shuffled; repeats of a row are counted before,
    the least key of a text is a grouped minimum, and it meets the rows by text and key, so copies of one text spread over
    the tasks. A null text is empty, a null part is the empty string. A row without a key has no smaller key and no label, and is
    no smaller key of others; rows that share the least key all pass E. A label counts if any of the key's rows has it.
    """
    rows = docs.select(name(key).alias("id"), F.coalesce(name(part).cast("string"), F.lit("")).alias("part"), own_failures(text_or_empty(text)).alias("of"))
    rows = rows.select("id", "part", "of.digest", "of.mask")
    rows = saved(rows.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-rows")
    firsts = rows.where("id is not null").groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("first"))
    with_first = rows.join(firsts, (F.col("digest") == F.col("d")) & (F.col("id") == F.col("first")), "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    flagged = with_first.select("id", "part", "n", F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask"),
                                # rows without a key match no label; they are dealt by their text
                                F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)).alias("salt"))
    known = labels.where(name("doc_id").isNotNull()).groupBy(name("doc_id").alias("l"), F.lit(0).cast("bigint").alias("z")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    told = flagged.join(known, (F.col("id") == F.col("l")) & (F.col("salt") == F.col("z")), "left")
    return told.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def audit(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """For rows ``part mask n good toxic`` (one per part and mask): every part, order of the filters and step of it.

    A part has at most two to the number of filters rows. Its matrix of masks (0 where a filter fails, else infinite) and the matrix
    of each filter's position in every order (the inverse permutations) are combined by min-plus: the least sum over
    the filters is the step that removes a mask in an order. The documents' counts are scattered to these steps; what fails a
    filter that stands behind its removal step is redundant there. An empty table gives an empty table.
    """
    if not 0 < len(set(filters)) == len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, each with a letter of its own")

    def of_part(key, table):
        import numpy as np
        import pyarrow as pa
        k = len(filters)
        orders = np.array(list(permutations(range(k))))
        position = np.argsort(orders, axis=1) + 1                                 # order x filter
        mask = table["mask"].to_numpy()
        weight = np.stack([table[c].to_numpy() for c in ("n", "good", "toxic")], axis=1)
        fails = (mask[:, None] >> np.arange(k)) & 1 == 1                          # mask x filter
        never = k + 1
        step = np.min(np.where(fails, 0, never)[:, None, :] + position[None], axis=2).clip(max=never)      # mask x order
        lost = np.zeros((len(orders), never, 3), dtype=np.int64)
        np.add.at(lost, (np.arange(len(orders))[None, :], step - 1), weight[:, None, :])
        lost = lost[:, :k]
        late = fails[:, None, :] & (position[None] > step[:, :, None])            # mask x order x filter
        redundant = np.take_along_axis(np.einsum("m,mof->of", weight[:, 0], late.astype(np.int64)), orders, axis=1)
        alone = np.array([weight[mask == 1 << f, 0].sum() for f in range(k)], dtype=np.int64)
        shapley = np.take_along_axis(lost[:, :, 0], position - 1, axis=1).sum(axis=0)
        n = len(orders)
        return pa.table({
            "part": pa.array([key[0].as_py()] * (n * k), pa.string()),
            "filter_order": pa.array(["".join(filters[f] for f in o) for o in orders for _ in range(k)], pa.string()),
            "step": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
            "kept": pa.array((weight[:, 0].sum() - np.cumsum(lost[:, :, 0], axis=1)).ravel()),
            "removed": pa.array(lost[:, :, 0].ravel()), "redundant": pa.array(redundant.ravel()),
            "unique_fails": pa.array(alone[orders].ravel()), "good_lost": pa.array(lost[:, :, 1].ravel()),
            "toxic_lost": pa.array(lost[:, :, 2].ravel()), "shapley": pa.array(shapley[orders].ravel())})

    return cells.select("part", "mask", *[F.col(c).cast("bigint").alias(c) for c in ("n", "good", "toxic")]).groupBy("part").applyInArrow(
        of_part, "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
                 "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")
