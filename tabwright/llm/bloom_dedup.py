"""Exact deduplication in two passes: a Bloom filter finds the hashes that may repeat, and only their rows shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import name, saved, text_or_empty, unfold, whole_rows

#: Bits per row, probes per hash, the filter's greatest size, and bytes per slice when filters are merged.
BITS_PER_ROW, PROBES, MOST_BYTES, SLICE = 16, 4, 64 << 20, 1 << 16


def normalized(text: Column) -> Column:
    """The text without its white space (the space and the control characters 9 to 13)."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")


def _places(hashes, bits):
    """Places of each hash in the filter: double hashing, every probe another odd multiple."""
    import numpy as np
    h = hashes.astype(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + np.uint64(i) * step) % np.uint64(bits)).astype(np.int64) for i in range(PROBES)]


def _bit(places):
    """The bit of each place in its byte."""
    import numpy as np
    return (1 << (places & 7)).astype(np.uint8)


def _holds(filter_, places):
    """Which hashes have all their places set."""
    import numpy as np
    return np.logical_and.reduce([(filter_[p >> 3] & _bit(p)) > 0 for p in places])


def repeated_filter(hashes: DataFrame, rows: int, most_bytes: int = MOST_BYTES) -> bytes:
    """A Bloom filter that holds every hash (column ``h``) that occurs twice or more, and few others.

    Each task keeps two bit sets: hashes seen, and hashes seen again. Two tasks' sets merge, slice by slice, into
    (either saw it; either saw it again, or both saw it). No repeated hash is missed. The filter has 16 bits per
    row up to ``most_bytes``; beyond that more rows pass for repeated, but the result stays whole.
    """
    size = SLICE
    while size * 8 < rows * BITS_PER_ROW and size < most_bytes:
        size *= 2
    bits = size * 8

    def seen(batches):
        import numpy as np
        once, again = np.zeros(size, dtype=np.uint8), np.zeros(size, dtype=np.uint8)
        for batch in batches:
            h, count = np.unique(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            places = _places(h, bits)
            known = (count > 1) | _holds(once, places)
            for p in places:
                np.bitwise_or.at(again, p[known] >> 3, _bit(p[known]))
                np.bitwise_or.at(once, p >> 3, _bit(p))
        used = [i for i in range(0, size, SLICE) if once[i:i + SLICE].any()]
        yield pa.RecordBatch.from_pydict({"slice": [i // SLICE for i in used], "once": [once[i:i + SLICE].tobytes() for i in used],
                                          "again": [again[i:i + SLICE].tobytes() for i in used]},
                                         schema=pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("again", pa.binary())]))

    def merged(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        once, again = np.zeros(SLICE, dtype=np.uint8), np.zeros(SLICE, dtype=np.uint8)
        for batch in batches:
            for a, b in zip(batch.column("once"), batch.column("again")):
                a, b = np.frombuffer(a.as_buffer(), np.uint8), np.frombuffer(b.as_buffer(), np.uint8)
                again |= b | (once & a)
                once |= a
        if again.any():
            yield pa.RecordBatch.from_pydict({"slice": [key[0].as_py()], "again": [again.tobytes()]},
                                             schema=pa.schema([("slice", pa.int32()), ("again", pa.binary())]))

    parts = hashes.select("h").mapInArrow(seen, "slice int, once binary, again binary")
    made = bytearray(size)
    for row in parts.groupBy("slice").applyInArrow(merged, "slice int, again binary").toLocalIterator():
        made[row["slice"] * SLICE:(row["slice"] + 1) * SLICE] = row["again"]
    return bytes(made)


def may_repeat(hashed: DataFrame, column: str, repeated: bytes) -> Column:
    """Whether a hash is in the filter, which every executor fetches once; its size has a fixed bound."""
    shared, bits = hashed.sparkSession.sparkContext.broadcast(repeated), len(repeated) * 8

    @pandas_udf("boolean")
    def found(h):
        import numpy as np
        import pandas as pd
        return pd.Series(_holds(np.frombuffer(shared.value, np.uint8), _places(h.to_numpy(dtype=np.int64).view(np.uint64), bits)))
    return found(F.col(column))


def _order() -> Column:
    """The row that stays comes first: most code points, then the smallest key (none last)."""
    return F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("n"), F.col("id"), F.col("at"))


def duplicate_table(df: DataFrame, key: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per row of the frame: ``key keep_id group_size kept text_sha256``.

    Texts are equal if they agree after white space is deleted; null counts as empty. Of equal texts the
    row with the most code points (of the text as it is), then the smallest key stays; of rows that repeat in
    both, exactly one. Rows whose hash cannot repeat are answered where they are. The others are grouped by their digest
    with partial minima, so thousands of copies meet as one row per task, and join back with their group.
    """
    digests = df.select(name(key).alias("id"), text_or_empty(text).alias("t"))
    digests = digests.select("id", F.length("t").cast("bigint").alias("points"), F.sha2(normalized(F.col("t")).cast("binary"), 256).alias("sha"))
    digests = saved(digests.withColumn("at", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("sha")), "dedup-digests")
    repeated = repeated_filter(digests, digests.count(), most_bytes)
    marked = saved(digests.withColumn("maybe", may_repeat(digests, "h", repeated)), "dedup-marked")
    alone = marked.where("not maybe").select(F.col("id").alias(key), F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
                                             F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    maybe = marked.where("maybe")
    groups = maybe.groupBy("sha").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("n")).select(F.col("sha").alias("s"), "first", "n")
    groups = saved(groups, "dedup-groups")      # a table of its own, so that the join can split a large group
    met = maybe.join(groups, F.col("sha") == F.col("s")).select(
        F.col("id").alias(key), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("at") == F.col("first.at")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(met)


def drop_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows that stay, whole, with the columns of the frame.

    Rows whose hash cannot repeat pass straight through; of the others one per digest is kept by a
    partial aggregate, so that copies are dropped before anything is shuffled.
    """
    rows = df.select(whole_rows(df).alias("row"), name(key).alias("id"), text_or_empty(text).alias("t"))
    rows = rows.select("row", "id", F.length("t").cast("bigint").alias("points"), F.sha2(normalized(F.col("t")).cast("binary"), 256).alias("sha"))
    rows = saved(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("h", F.xxhash64("sha")), "dedup-rows")
    repeated = repeated_filter(rows, rows.count(), most_bytes)
    marked = rows.withColumn("maybe", may_repeat(rows, "h", repeated))
    alone = marked.where("not maybe").select("row")
    stays = rows.select("sha", "points", "id", "at", "h").withColumn("maybe", may_repeat(rows, "h", repeated)).where("maybe").groupBy("sha").agg(
        F.min(_order()).alias("first")).select(F.col("first.at").alias("a"))
    met = marked.where("maybe").join(stays, F.col("at") == F.col("a"), "left_semi").select("row")
    return unfold(alone.unionByName(met), "row", df.columns, [], [])
