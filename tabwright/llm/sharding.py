"""Sharding by a two-pass external shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_below, name, saved, text_or_empty, unfold, whole_rows

SHARDS, BUCKET_BYTES, LEAST_BUCKETS, SEED = 24, 64 << 20, 256, 20_240_601


def shuffled(df: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """The rows in random order: a written table of the whole ``row``, its ``size``, ``crc``, ``bucket`` and ``place``.

    First pass: every row is scattered by a seeded hash of its key and text to one of so many buckets that one
    holds about ``bucket_bytes`` (256 buckets at least, for parallel work). Second pass: each bucket is brought into
    a definite order, Fisher-Yates shuffled with a seed of its own, and written. Reruns give the same order.
    """
    t = text_or_empty(text).cast("binary")
    rows = df.select(whole_rows(df).alias("row"), name(key).alias("id"), F.octet_length(t).cast("bigint").alias("bytes"), F.crc32(t).alias("crc"))
    total = df.agg(F.sum(F.octet_length(text_or_empty(text)).cast("bigint") + 8)).head()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "id", "crc", "bytes"), F.lit(buckets)))
    schema = T.StructType([*rows.schema.fields, T.StructField("place", T.LongType())])

    def fisher_yates(key_, table):
        import numpy as np
        import pyarrow as pa
        table = table.sort_by([("id", "ascending"), ("crc", "ascending"), ("bytes", "ascending")])
        order = np.random.Generator(np.random.PCG64([seed, key_[0].as_py()])).permutation(table.num_rows)
        return table.take(pa.array(order)).append_column("place", pa.array(np.arange(len(order), dtype=np.int64)))

    return saved(rows.groupBy("bucket").applyInArrow(fisher_yates, schema), "shuffled")


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """Every row with its ``shard`` (0 to ``shards`` - 1) and its ``slot`` in it (gapless from 0).

    The shuffled buckets follow one another; a row's position is its place in its bucket plus the rows of
    earlier buckets, and each shard is an equal run of positions, so that shards differ by one row at most. A null
    text has no bytes; repeated rows each have a slot; rows without a key scatter by their text. An empty
    table gives an empty table. Input columns named like a result give way.
    """
    rows = shuffled(df, key, text, bucket_bytes, seed)
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    # one row per bucket of 64 MB, whatever the number of rows
    before = F.coalesce(F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = saved(sizes.select(F.col("bucket").alias("b"), "n", before.alias("start")), "shard-starts")
    total = starts.agg(F.sum("n")).head()[0] or 1
    placed = rows.join(broadcast_below(starts.drop("n")), F.col("bucket") == F.col("b"))
    placed = placed.withColumn("at", F.col("start") + F.col("place"))
    placed = placed.withColumn("number", F.expr(f"(at * {shards}L) div {total}L"))
    first = F.expr(f"(number * {total}L + {shards - 1}L) div {shards}L")
    return unfold(placed, "row", df.columns, [F.col("number").cast("int"), F.col("at") - first], ["shard", "slot"])


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> None:
    """Write the shards as folders ``shard=0`` to ``shard=23`` of Parquet files, rows in the order of their slots."""
    made = shard(df, key, text, shards)
    made.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
