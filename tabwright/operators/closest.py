"""The closest text of another table for each text: a search that leaves out what an upper bound rules out.

The letters that two texts have in common, counted with repeats, bound their common subsequence, and so their score. Texts
of the searched table stand in chunks, sorted, and in groups of neighbours that know the most of each letter they
hold. A text looks at the groups first, then at the texts of those that can still reach its best score so far, and only scores what is left.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.similarity import partial_ratios, ratios, set_ratios
from .stable import stable

if TYPE_CHECKING:
    import pyarrow as pa

# ship the search with its tasks, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Texts of a chunk, texts of a group of neighbours, kinds of letters that are told apart, and texts that are scored first.
CHUNK, GROUP, LETTERS, FIRST = 1024, 32, 97, 4


def letters(texts: list[str]) -> np.ndarray:
    """How often each kind of letter (code point modulo `LETTERS`) stands in each text."""
    made = np.zeros((len(texts), LETTERS), dtype=np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4") % LETTERS
    np.add.at(made, (np.repeat(np.arange(len(texts)), sizes), codes.astype(np.int64)), 1)
    return made


class Seen:
    """Texts as a method sees them: their main strings, the ones without spaces, and the letters of both."""

    def __init__(self, texts: list[str], method: str):
        words = [t.split() for t in texts]
        self.texts, self.method = texts, method
        if method == "token_set":
            self.main = [" ".join(sorted(set(w))) for w in words]
        else:
            self.main = [" ".join(sorted(w)) for w in words] if method == "token_sort" else texts
        self.bare = [t.replace(" ", "") for t in texts]
        self.views = [(letters(some), np.fromiter(map(len, some), np.int64, len(some))) for some in (self.main, self.bare)]


def bounds(mine: tuple, theirs: tuple, contained: bool) -> np.ndarray:
    """The most that each text (letters, length) can score against each of the others or groups (most letters, least length)."""
    common = np.stack([np.minimum(row, theirs[0]).sum(axis=1) for row in mine[0]]) if len(mine[0]) else np.zeros((0, len(theirs[0])))
    n, m = mine[1][:, None], theirs[1][None, :]
    # a common part of words or a window may leave the longer text's rest out of the count
    total = common + np.minimum(n, m) if contained else n + np.maximum(m, common)
    return np.where(total > 0, 200.0 * np.minimum(common, total / 2) / np.maximum(total, 1), 100.0)


def whole_scores(a: Seen, i: np.ndarray, b: Seen, j: np.ndarray) -> np.ndarray:
    """Scores of pairs of texts, in one batch."""
    if len(i) == 0:
        return np.zeros(0, dtype=np.int64)
    x, y = [a.main[k] for k in i], [b.main[k] for k in j]
    if a.method == "partial":
        best = partial_ratios(x, y)
    elif a.method == "token_set":
        best = set_ratios(x, y)
    else:
        best = ratios(x, y)
    best = np.maximum(best, ratios([a.bare[k] for k in i], [b.bare[k] for k in j]))
    return np.floor(best + 0.5).astype(np.int64)


def closest_in(queries: Seen, best: np.ndarray, rows: np.ndarray, others: Seen, first: np.ndarray) -> int:
    """Better ``best`` scores and their first ``rows`` (the smaller of equal scores) among the others; returns the pairs scored."""
    contained = queries.method in ("token_set", "partial")
    groups = np.arange(0, len(first), GROUP)
    least_row = np.minimum.reduceat(first, groups)

    def reach(mine, gather):
        made = [bounds((v[0][mine], v[1][mine]), gather(w), contained and k == 0) for k, (v, w) in enumerate(zip(queries.views, others.views))]
        return np.floor(np.maximum(*made) + 0.5 + 1e-9).astype(np.int64)

    def open_(top, row, mine):
        return (top > best[mine][:, None]) | ((top == best[mine][:, None]) & (row[None] < rows[mine][:, None]))

    scored = 0

    def score(i, j):
        nonlocal scored
        scored += len(i)
        got = whole_scores(queries, i, others, j)
        order = np.lexsort((first[j], -got, i))
        i, j, got = i[order], j[order], got[order]
        lead = np.flatnonzero(np.diff(i, prepend=-1))
        for q, s, r in zip(i[lead], got[lead], first[j[lead]]):
            if (s, -r) > (best[q], -rows[q]):
                best[q], rows[q] = s, r

    by_group = reach(np.arange(len(best)), lambda w: (np.maximum.reduceat(w[0], groups), np.minimum.reduceat(w[1], groups)))
    for at in range(0, len(best), 64):
        mine = np.arange(at, min(at + 64, len(best)))
        held = np.flatnonzero(open_(by_group[mine], least_row, mine).any(axis=0))
        if len(held) == 0:
            continue
        j = np.concatenate([np.arange(g, min(g + GROUP, len(first))) for g in groups[held]])
        top = reach(mine, lambda w: (w[0][j], w[1][j]))
        for some in (FIRST, len(j)):                       # the most hopeful first, then all that can still be closer
            left = open_(top, first[j], mine)
            if some < len(j):
                cut = -np.partition(-top, some - 1, axis=1)[:, some - 1:some]
                left &= top >= np.maximum(cut, 1)
            q, k = np.nonzero(left)
            top[q, k] = -1                                 # scored once
            score(mine[q], j[k])
    return scored


def _chunks(nodes: DataFrame, extra: str) -> DataFrame:
    """Rows ``block number ids texts extra`` of at most `CHUNK` texts of one block, neighbours in order of their texts."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        block, ids, texts, more = None, [], [], []

        def made():
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.string()), "ids": pa.array([ids], pa.list_(pa.int64())),
                                               "texts": pa.array([texts], pa.list_(pa.string())), extra: pa.array([more], pa.list_(pa.int64()))})
        for batch in batches:
            for b, i, t, x in zip(*[batch.column(c).to_pylist() for c in ("block", "id", "text", extra)]):
                if ids and (b != block or len(ids) == CHUNK):
                    yield made()
                    ids, texts, more = [], [], []
                block = b
                ids.append(i)
                texts.append(t)
                more.append(x)
        if ids:
            yield made()

    spread = nodes.select("block", F.col("id").cast("bigint").alias("id"), "text", F.col(extra).cast("bigint").alias(extra))
    spread = spread.repartitionByRange("block", "text").sortWithinPartitions("block", "text")
    return spread.mapInArrow(build, f"block string, ids array<bigint>, texts array<string>, {extra} array<bigint>").withColumn(
        "number", F.monotonically_increasing_id())


def closest_texts(nodes: DataFrame, others: DataFrame, method: str) -> DataFrame:
    """``id score row``: for each text (``id block text``) the highest score among the other table's texts of its block (``id block
    text first_row``), and the smallest first row of those that have it. Blocks without other texts give no row.

    Texts meet in chunks, a block's chunks dealt over as many tasks as it has chunks, so no block gathers in a task. A first
    pass compares each chunk with one chunk of its block; its best scores then rule out most of the rest.
    """
    spark = nodes.sparkSession
    wanted = stable(_chunks(nodes.withColumn("none", F.lit(0)), "none").drop("none"))
    held = _chunks(others, "first_row")
    place = F.row_number().over(W.partitionBy("block").orderBy("number")) - 1
    # one row per 1,024 texts of a block
    held = stable(held.withColumn("place", place).withColumn("of", F.count(F.lit(1)).over(W.partitionBy("block"))))
    sizes = held.groupBy("block").agg(F.first("of").alias("of"))
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        for batch in batches:
            for r in batch.to_pylist():
                queries, first = Seen(r["texts"], method), np.array(r["first_row"], dtype=np.int64)
                best, rows = np.array(r["best"], dtype=np.int64), np.array(r["rows"], dtype=np.int64)
                if r["best"][0] < 0:                       # nothing yet: the first of these rows, with nothing in common
                    best, rows = np.zeros(len(best), dtype=np.int64), np.full(len(best), first.min())
                closest_in(queries, best, rows, Seen(r["others"], method), first)
                yield pa.RecordBatch.from_pydict({"number": pa.array([r["number"]] * len(best), pa.int64()), "id": pa.array(r["ids"], pa.int64()),
                                                  "score": pa.array(best.astype(np.int32), pa.int32()), "row": pa.array(rows, pa.int64())})

    def searched(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("number", "ids", "texts", "best", "rows", "others", "first_row").repartition(spread)
        return pairs.mapInArrow(search, "number bigint, id bigint, score int, row bigint")

    theirs = held.select("block", "place", F.col("texts").alias("others"), "first_row")
    start = wanted.join(sizes, "block").withColumn("place", F.pmod(F.xxhash64("number"), F.col("of")))
    none = F.transform("ids", lambda _: F.lit(-1))
    found = stable(searched(start.select("*", none.alias("best"), none.alias("rows")).join(theirs, ["block", "place"])))
    rest = start.where("of > 1")
    if not rest.isEmpty():
        so_far = found.groupBy("number").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("score", "row")))).alias("so_far"))
        rest = rest.join(so_far, "number").select(
            "block", "number", "ids", "texts", F.col("place").alias("done"), F.transform("ids", lambda i: F.col("so_far")[i]["score"]).alias("best"),
            F.transform("ids", lambda i: F.col("so_far")[i]["row"]).alias("rows"), F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("place"))
        found = found.unionByName(searched(rest.where("place <> done").join(theirs, ["block", "place"])))
    top = found.groupBy("id").agg(F.max(F.struct("score", (-F.col("row")).alias("neg"))).alias("top"))
    return top.select("id", F.col("top.score").alias("score"), (-F.col("top.neg")).alias("row"))

