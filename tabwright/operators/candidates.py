"""Pairs of texts that can reach a similarity threshold, found by equi-joins on rare letter groups.

A score of at least T leaves at most ``(1 - t)(n + m)`` inserted or deleted letters between two texts of
n and m letters (t is T less half a point, since scores are rounded). Every such edit destroys at most two
letter pairs, so the texts must share a computable number of them. By the prefix-filter argument
(Chaudhuri et al. 2006; Bayardo et al. 2007) both texts then share one among their few rarest letter
pairs: joining on those loses nothing and never compares everything with everything. Below t = 0.75 the
bound on letter pairs is empty and single letters take their place. Where one text's words must stand in the other,
whole words take the place of letter pairs, each counted by its letters.

Texts also carry 64 bits of their letters (or words). Every edit changes one bit at most, so the join itself drops what
differs in more bits than the threshold allows edits.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from typing import TYPE_CHECKING, NamedTuple
from zlib import crc32

import numpy as np
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.similarity import similarity

if TYPE_CHECKING:
    import pyarrow as pa

# ship the grams with their tasks, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SLACK = 1e-9
#: Buckets in which the frequencies of grams are counted.
BUCKETS = 1 << 16


class View(NamedTuple):
    """One reason why two texts may score high."""
    name: str
    string: Column          # the text as this view sees it (from column "text")
    pairs: bool             # letter pairs, else single letters
    padded: bool            # a space before and after counts as a letter
    prefix_left: bool       # join only the rarest grams of the left text, else all
    prefix_right: bool
    contained: bool         # the bound holds for the prefixed side alone, whatever the other's length
    edits: bool             # the strings themselves are within the edit distance
    words: bool = False     # distinct words, each weighing its letters and a space, in place of letters


def _sorted_words(distinct: bool) -> Column:
    words = F.array_remove(F.split(F.col("text"), " "), "")
    return F.array_join(F.sort_array(F.array_distinct(words) if distinct else words), " ")


def _views(method: str, t: float, compact: bool) -> list[View]:
    pairs = t > 0.75
    text, bare = F.col("text"), F.replace(F.col("text"), F.lit(" "), F.lit(""))
    both = dict(pairs=pairs, padded=pairs, prefix_left=True, prefix_right=True, contained=False)
    if method == "token_sort":
        views = [View("words", _sorted_words(False), edits=True, **both)]
    elif method == "simple":
        views = [View("text", text, edits=True, **both)]
    elif method == "token_set":
        words = _sorted_words(True)
        views = [View("set", words, edits=False, **both)]
        views += [View(f"sub{left}", words, True, True, left, not left, True, False, True) for left in (True, False)]
    else:
        views = [View(f"part{two}{left}", text, two, False, left, not left, True, False)
                 for two in (True, False) for left in (True, False)]
    if compact:
        views.append(View("bare", bare, edits=True, **both))
    return views


def _needed(view: View, n: Column, t: float) -> Column:
    """Least number of shared grams for a text of n letters."""
    share = t / (2 - t)
    if view.contained and view.padded:          # shared words cover this part of the text
        raw = n * share + 1
    elif view.contained and view.pairs:         # a window of the longer text
        raw = n * (4 * t - 3) - 1
    elif view.pairs:
        raw = n + 1 - n * 4 * (1 - t)
    else:
        raw = n * share
    return F.greatest(F.ceil(raw - _SLACK), F.lit(1))


def _cut(nodes: DataFrame, view: View, number: int, t: float, left: bool) -> DataFrame:
    """(view, id, block, n, total, keep, seen): every text as one view sees it. ``keep`` is how many of its rarest grams are joined on."""
    s, n = F.col("_s"), F.length("_s")
    base = nodes.withColumn("_s", view.string).filter(n > 0)
    prefixed = view.prefix_left if left else view.prefix_right
    if view.contained and not view.padded and prefixed:
        # a text uses letter pairs if their bound is not empty, else single letters; the other text both
        by_pairs = n * (4 * t - 3) - 1 >= 1
        base = base.filter(by_pairs if view.pairs else ~by_pairs)
    padded = F.concat(F.lit(" "), s, F.lit(" ")) if view.padded else s
    total = n + (2 if view.padded else 0) - (1 if view.pairs else 0)
    keep = F.greatest(total - _needed(view, n, t) + 1, F.lit(0)).cast("int") if prefixed else total
    return base.filter(total >= 1).select(F.lit(number).alias("view"), "id", "block", n.alias("n"),
                                          total.alias("total"), keep.alias("keep"), padded.alias("seen"))


def _grams(text: str, width: int) -> list[str]:
    """The letter pairs (or letters) of a text, repeats numbered; its distinct words for width 0."""
    if not width:
        return list(dict.fromkeys(text.split()))
    met: dict[str, int] = {}
    made = []
    for i in range(len(text) - width + 1):
        gram = text[i:i + width]
        met[gram] = k = met.get(gram, 0) + 1
        made.append(f"{gram}{k}")
    return made


def _bits(grams: list[str]) -> int:
    """64 bits, one set by each gram, as a signed number."""
    made = 0
    for g in grams:
        made |= 1 << (_hash(g) & 63)
    return made - (1 << 64) if made >> 63 else made


def _hash(gram: str) -> int:
    return crc32(gram.encode("utf-8", "surrogatepass"))


def _bucket(gram: str) -> int:
    return _hash(gram) % BUCKETS


def _frequencies(cut: DataFrame, widths: list[int]) -> np.ndarray:
    """How many grams of each view fall into each bucket: a table of fixed size, whatever the texts. Every task counts
    its own, and Spark adds them up."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        made = np.zeros((len(widths), BUCKETS), dtype=np.int64)
        for batch in batches:
            for view, text in zip(batch.column("view").to_pylist(), batch.column("seen").to_pylist()):
                np.add.at(made[view], [_bucket(g) for g in _grams(text, widths[view])], 1)
        at = np.flatnonzero(made)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int64()), "f": pa.array(made.ravel()[at], pa.int64())})

    made = np.zeros(len(widths) * BUCKETS, dtype=np.int64)
    for at, f in cut.select("view", "seen").mapInArrow(count, "at bigint, f bigint").groupBy("at").agg(F.sum("f")).collect():
        made[at] = f
    return made.reshape(len(widths), BUCKETS)


def _index(cut: DataFrame, frequency: Broadcast, widths: list[int], side: str) -> DataFrame:
    """The rarest grams of each text, as many as needed, with their place (the weight of rarer ones). They are chosen within the
    row: any order that both sides share will do, so it goes by the frequency of the gram's bucket. Only these grams become
    rows. ``bits`` are those of the text's letters or words, ``must`` those of the words it cannot do without."""
    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa
        for batch in batches:
            of, grams, places, bits, musts = [], [], [], [], []
            for i, (v, t, k) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("view", "seen", "keep")])):
                f, width = frequency.value[v], widths[v]
                found, place = _grams(t, width), 0
                seen = _bits(found if width < 2 else _grams(t, 1))
                # a word that weighs more than may be missing
                must = 0 if width else _bits([g for g in found if len(g) + 1 >= k])
                for _, g in sorted([(f[_bucket(g)], g) for g in found]):
                    if place >= k:
                        break
                    of.append(i)
                    grams.append(g)
                    places.append(place)
                    bits.append(seen)
                    musts.append(must)
                    place += 1 if width else len(g) + 1
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_pydict({
                "view": batch.column("view").take(of), "block": batch.column("block").take(of), "gram": pa.array(grams, pa.string()),
                f"place_{side}": pa.array(places, pa.int32()), f"bits_{side}": pa.array(bits, pa.int64()),
                f"must_{side}": pa.array(musts, pa.int64()), f"id_{side}": batch.column("id").take(of),
                f"n_{side}": batch.column("n").take(of), f"total_{side}": batch.column("total").take(of)})

    placed = cut.filter("keep > 0").select("view", "block", F.col("id").cast("bigint").alias("id"), "n", "total", "seen", "keep")
    return placed.mapInArrow(rarest, f"view int, block string, gram string, place_{side} int, bits_{side} bigint, must_{side} bigint, "
                                     f"id_{side} bigint, n_{side} int, total_{side} int")


def _possible(view: View, t: float) -> Column:
    """Whether a met pair can still reach the threshold, judged by lengths and places."""
    na, nb = F.col("n_a"), F.col("n_b")
    # the gram they met on and the rarer side's remaining ones are all they can still share
    rest = F.least(F.col("total_a") - F.col("place_a"), F.col("total_b") - F.col("place_b"))
    if view.contained:
        mine, other = (na, nb) if view.prefix_left else (nb, na)
        fits = rest >= _needed(view, mine, t)
        if view.words:
            must, bits = ("must_a", "bits_b") if view.prefix_left else ("must_b", "bits_a")
            return fits & (F.col(must).bitwiseAND(F.bitwise_not(F.col(bits))) == 0)
        return fits & (mine <= other)
    shorter, longer = F.least(na, nb), F.greatest(na, nb)
    shared = longer + 1 - (na + nb) * 2 * (1 - t) if view.pairs else (na + nb) * t / 2
    # an inserted or deleted letter changes one bit at most
    alike = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= F.floor((na + nb) * (1 - t) + _SLACK)
    return alike & (shorter >= longer * (t / (2 - t)) - _SLACK) & (rest >= F.greatest(F.ceil(shared - _SLACK), F.lit(1)))


def _close(view: View, t: float) -> Column:
    """Whether the strings are near enough. The built-in edit distance is never above the insert/delete
    distance and stops at its limit: a cheap last test before scoring."""
    if view.words:
        mine, other = [F.array_distinct(F.array_remove(F.split(c, " "), "")) for c in (
            ("text_a", "text_b") if view.prefix_left else ("text_b", "text_a"))]
        weight = F.aggregate(F.array_intersect(mine, other), F.lit(0), lambda n, w: n + F.length(w) + 1)
        return weight >= _needed(view, F.length(F.array_join(mine, " ")), t)
    if not view.edits:
        return F.lit(True)
    a, b = _seen(view, "text_a"), _seen(view, "text_b")
    limit = F.floor((F.length(a) + F.length(b)) * (1 - t) + _SLACK).cast("int")
    return F.call_function("levenshtein", a, b, limit) >= 0


def _seen(view: View, column: str) -> Column:
    c = F.col(column)
    if view.name == "words":
        return F.array_join(F.sort_array(F.split(c, " ")), " ")
    return F.replace(c, F.lit(" "), F.lit("")) if view.name == "bare" else c


def hopeful_pairs(left: DataFrame, right: DataFrame, views: list[View], t: float, ordered: bool = False) -> DataFrame:
    """(id_a, id_b, views): the pairs that meet on a rare gram in some views and can reach the threshold by what the index knows."""
    widths = [0 if v.words else 2 if v.pairs else 1 for v in views]
    # a fixed number of partitions: grams and scores are heavier than their bytes suggest, so they must not be merged
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut_a, cut_b = [reduce(DataFrame.unionAll, [_cut(nodes.repartition(tasks, "id"), v, i, t, is_left) for i, v in enumerate(views)])
                    for nodes, is_left in ((left, True), (right, False))]
    # where only one side is cut to its rarest grams, those that are rare on the other side meet the fewest texts
    counted = [cut.filter(F.col("view").isin([i for i, v in enumerate(views) if not (v.contained and prefixed(v))]))
               for cut, prefixed in ((cut_a, lambda v: v.prefix_left), (cut_b, lambda v: v.prefix_right))]
    frequency = left.sparkSession.sparkContext.broadcast(_frequencies(counted[0].unionAll(counted[1]), widths))
    # grams are many times the texts, and texts many times their compressed bytes, which size estimates overlook: no join here
    # must be broadcast
    met = _index(cut_a, frequency, widths, "a").join(_index(cut_b, frequency, widths, "b").hint("merge"), ["view", "block", "gram"])
    if ordered:
        met = met.filter("id_a < id_b")
    hopeful = reduce(lambda test, i: test.when(F.col("view") == i, _possible(views[i], t)), range(len(views)), F)
    return met.filter(hopeful).groupBy("id_a", "id_b").agg(F.collect_set("view").alias("views"))


def similar_texts(left: DataFrame, right: DataFrame, threshold: int, method: str = "token_sort",
                  compact: bool = True, ordered: bool = False) -> DataFrame:
    """All pairs (id_a, id_b, score) with a score of at least ``threshold`` within a block.

    Both inputs are distinct texts: (id, block, text). ``ordered`` keeps only id_a < id_b, for comparing
    a set of texts with itself.
    """
    if not 1 <= threshold <= 100:
        raise ValueError("threshold must be between 1 and 100")
    if method not in C.METHODS:
        raise ValueError(f"method must be one of {C.METHODS}, not {method!r}")
    t = (threshold - 0.5) / 100
    views = _views(method, t, compact)
    pairs = hopeful_pairs(left, right, views, t, ordered)
    pairs = (pairs.join(left.select(F.col("id").alias("id_a"), F.col("text").alias("text_a")).hint("merge"), "id_a")
             .join(right.select(F.col("id").alias("id_b"), F.col("text").alias("text_b")).hint("merge"), "id_b"))
    near = reduce(lambda x, y: x | y, [F.array_contains("views", i) & _close(v, t) for i, v in enumerate(views)])
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    score = similarity(F.col("text_a"), F.col("text_b"), method, compact).alias("score")
    scored = pairs.filter(near).repartition(tasks, "id_a", "id_b").select("id_a", "id_b", score)
    return scored.filter(F.col("score") >= threshold)
