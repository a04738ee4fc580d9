"""Best-fit packing of token pieces into sequences under several capacities at once."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import name, saved, text_or_empty
from .tokens import TOKENIZERS, encoder

#: Tokens, documents and attention cost (sum of squared lengths) that one sequence holds.
CAPACITIES = (2048, 2048, 2048 * 2048)
#: Weights of the capacities in the residual norm.
WEIGHTS = (1.0, 0.001, 0.001)
GROUP, LEFT_OVER, CLOSER = 4096, 0.99, 2
END = 0


def tokenized(df: DataFrame, text: str = "text", longest: int = CAPACITIES[0], folder: str = TOKENIZERS) -> DataFrame:
    """The pieces of every text of a frame with ``id``: ``id piece start length ids ids_crc32``.

    ``ids`` are little-endian unsigned 32-bit numbers; every text ends with the id 0. A text with more than
    ``longest`` ids is cut from its end, so that only its first piece can be shorter.
    """
    def pieces(batches):
        import numpy as np
        import pyarrow as pa
        made = encoder(folder)
        for batch in batches:
            at, cols = [], ([], [], [], [], [])
            for i, t in enumerate(batch.column("text")):
                ids = np.array([*made.ids(t.as_py()), END], dtype="<u4")
                first = len(ids) % longest or longest if len(ids) > longest else len(ids)
                for k, start in enumerate([0, *range(first, len(ids), longest)]):
                    part = ids[start:first if not k else start + longest].tobytes()
                    for col, v in zip(cols, (k, start, len(part) // 4, part, zlib.crc32(part))):
                        col.append(v)
                    at.append(i)
                if len(at) >= 2048:
                    yield _batch(pa, batch, at, cols)
                    at, cols = [], ([], [], [], [], [])
            if at:
                yield _batch(pa, batch, at, cols)

    source = df.select(name("id").alias("id"), text_or_empty(text).alias("text"))
    return source.mapInArrow(pieces, "id " + dict(df.dtypes)["id"] + ", piece int, start bigint, length bigint, ids binary, ids_crc32 bigint")


def _batch(pa, batch, at, cols):
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    names = ["piece", "start", "length", "ids", "ids_crc32"]
    ids = batch.column("id").take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["id", *names])


def best_fit(lengths, capacities: Sequence[int] = CAPACITIES, weights: Sequence[float] = WEIGHTS):
    """Bins and offsets of the pieces, by vector best-fit decreasing.

    Every piece asks for (its tokens, 1 document, its squared length). Longest first, it goes to the open
    bin that keeps within every capacity and is left with the smallest weighted norm of relative residuals; if there
    is none, it opens a bin. Raises if a piece alone is above a capacity.
    """
    import numpy as np
    lengths = np.asarray(lengths, dtype=np.int64)
    asks = np.stack([lengths, np.ones_like(lengths), lengths * lengths])
    caps = np.asarray(capacities, dtype=np.int64)
    if (asks > caps[:, None]).any():
        raise ValueError("a piece is above a capacity")
    scale = np.asarray(weights, dtype=np.float64) / caps.astype(np.float64) ** 2
    left = np.empty((3, max(len(lengths), 1)), dtype=np.int64)
    of, live = np.empty(max(len(lengths), 1), dtype=np.int64), 0   # the open bins and their numbers
    bins, offsets, made = np.empty_like(lengths), np.empty_like(lengths), 0
    for i in np.argsort(-lengths, kind="stable"):
        ask = asks[:, i]
        after = left[:, :live] - ask[:, None]
        fits = np.flatnonzero((after >= 0).all(axis=0))
        if len(fits):
            at = fits[np.argmin(scale @ (after[:, fits].astype(np.float64) ** 2))]
        else:
            at, live = live, live + 1
            left[:, at], of[at], made = caps, made, made + 1
        bins[i], offsets[i] = of[at], caps[0] - left[0, at]
        left[:, at] -= ask
        if left[:2, at].min() <= 0:       # full: the last open bin takes its place
            live -= 1
            left[:, at], of[at] = left[:, live], of[live]
    return bins, offsets


def _pack(pieces: DataFrame, level: int, group: int, capacities, weights) -> DataFrame:
    """Pack (``row``, ``length``) within random groups of about ``group`` pieces."""
    groups = max(1, -(-pieces.count() // group))

    def work(table):
        import numpy as np
        import pyarrow as pa
        table = table.sort_by("row")
        lengths = table.column("length").to_numpy()
        bins, offsets = best_fit(lengths, capacities, weights)
        filled = np.bincount(bins, weights=lengths).astype(np.int64)
        number = (level << 60) + (table.column("g").to_numpy() << 28) + bins
        return pa.table({"row": table.column("row"), "length": lengths, "sequence_id": number, "offset": offsets, "filled": filled[bins]})

    dealt = pieces.select("row", "length", F.pmod(F.xxhash64(F.lit(level), "row"), F.lit(groups)).alias("g"))
    return dealt.groupBy("g").applyInArrow(work, "row bigint, length bigint, sequence_id bigint, offset bigint, filled bigint")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", capacities: Sequence[int] = CAPACITIES,
         weights: Sequence[float] = WEIGHTS, group: int = GROUP, folder: str = TOKENIZERS) -> DataFrame:
    """One row per piece: ``key piece start length ids ids_crc32 sequence_id offset``.

    The texts are tokenized once into a written table; from there only row numbers and lengths move. Pieces are dealt
    at random to groups of about ``group``, which stand for the whole and are packed side by side; the pieces of
    sequences filled below 99 % meet again in other groups, twice. A null text is empty: its one piece is the end
    id. Repeated rows are packed as documents of their own. An empty table gives an empty table.
    """
    made = tokenized(df.select(name(key).alias("id"), text_or_empty(text).alias("text")), "text", capacities[0], folder)
    made = saved(made.withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    todo, done = made.select("row", "length"), []
    for level in range(CLOSER + 1):
        packed = saved(_pack(todo, level, group, capacities, weights), "pack-bins")
        loose = F.col("filled") < int(LEFT_OVER * capacities[0])
        done.append(packed if level == CLOSER else packed.where(~loose))
        todo = packed.where(loose).select("row", "length")
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    # never broadcast: the size of a compressed table of numbers says little about its size in memory
    return made.join(placed.select("row", "sequence_id", "offset").hint("merge"), "row").select(
        F.col("id").alias(key), "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset")
