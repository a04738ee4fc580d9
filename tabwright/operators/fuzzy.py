"""Comparing two tables by similar names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.equality import values_equal
from ..functions.text import col, match_text_of, norm_text, typed, value_text
from .assign import MOST_IN_TASK, assign
from .candidates import similar_texts
from .closest import closest_texts
from .compare import _difference_rows, common_columns
from .rows import ROW, data_columns, ensure_rows
from .stable import stable


def _side(df: DataFrame, keys: Sequence[str], must: Sequence[str], words: Sequence[str],
          ignore_case: bool) -> DataFrame:
    """(row, block, text): what a row is matched by."""
    blocks = [norm_text(*typed(df, c), ignore_case) for c in must]
    block = F.to_json(F.array(*blocks)) if blocks else F.lit("")
    return df.select(F.col(ROW).cast("bigint").alias("row"), block.alias("block"),
                     match_text_of(df, keys, words).alias("text"))


def _groups(side: DataFrame) -> DataFrame:
    """One node per distinct (block, text) with its first row; empty texts never match."""
    made = side.where("text <> ''").groupBy("block", "text").agg(F.min("row").alias("first_row"))
    return stable(made.withColumn("id", F.monotonically_increasing_id()))


class FuzzyComparison:
    """Pair rows of A and B whose key text is similar (0 to 100), best pairs first, each row at most once.

    Only rows that agree on the ``must_match`` columns are compared. ``pairs`` are the matched row numbers;
    ``matches``, ``diffs``, ``only_a``, ``only_b`` and ``stats`` are built when asked for. Rows left over
    come with the closest text of the other table, used or not. It is found among the texts of its block by a search that leaves out
    whatever its letters keep from being closer (`closest_texts`). ``closest_from`` leaves out closest texts below a score; 0, the
    default, gives every row one, however little it resembles.
    """

    def __init__(self, a: DataFrame, b: DataFrame, key_a: Sequence[str], key_b: Sequence[str],
                 compare_columns: Mapping[str, str] | None = None, threshold: int = 85,
                 method: str = "token_sort", must_match: Mapping[str, str] | None = None,
                 ignore_words: Sequence[str] = (), review_below: int = 95, tolerance: float = 0.0,
                 ignore_case: bool = True, closest_from: int = 0, most_in_task: int = MOST_IN_TASK):
        must = dict(must_match or {})
        self.a, self.b, self.key_a, self.key_b = ensure_rows(a), ensure_rows(b), list(key_a), list(key_b)
        if not compare_columns:
            compare_columns = common_columns(self.a, self.b, [*key_a, *key_b, *must, *must.values()])
        self.compare_columns = dict(compare_columns)
        self.threshold, self.method, self.closest_from = threshold, method, closest_from
        self.review_below, self.tolerance, self.ignore_case = review_below, tolerance, ignore_case
        # texts are worked out once per row; all later steps know rows by the number of their group
        side_a = stable(_side(self.a, key_a, list(must), ignore_words, ignore_case))
        side_b = stable(_side(self.b, key_b, list(must.values()), ignore_words, ignore_case))
        self.nodes_a, self.nodes_b = _groups(side_a), _groups(side_b)
        self.members_a, self.members_b = [stable(side.join(nodes.select("block", "text", "id"), ["block", "text"]).select("id", "row"))
                                          for side, nodes in ((side_a, self.nodes_a), (side_b, self.nodes_b))]
        self.edges = stable(similar_texts(self.nodes_a, self.nodes_b, threshold, method))
        self.pairs = stable(assign(self.edges.select(F.col("id_a").alias("u"), F.col("id_b").alias("v"), "score"),
                                   self.members_a.select(F.col("id").alias("u"), "row"),
                                   self.members_b.select(F.col("id").alias("v"), "row"), most_in_task))

    @cached_property
    def _joined(self) -> DataFrame:
        """Matched rows with the key and compared cells of both sides and what differs."""
        names_a = [*self.key_a, *self.compare_columns]
        names_b = [*self.key_b, *self.compare_columns.values()]

        def cells(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
            return df.select(F.col(ROW).cast("bigint").alias(f"row_{label}"),
                             *[typed(df, c)[0].alias(f"_{label}{i}") for i, c in enumerate(columns)])

        joined = self.pairs.join(cells(self.a, names_a, "a"), "row_a").join(cells(self.b, names_b, "b"), "row_b")
        keys = ([F.col(f"_a{i}").alias(f"{k} (A)") for i, k in enumerate(self.key_a)]
                + [F.col(f"_b{i}").alias(f"{k} (B)") for i, k in enumerate(self.key_b)])
        different = sum([(~s).cast("int") for s in self._same], F.lit(0))
        return joined.select("*", *keys, F.col("score").alias("similarity_pct"), different.alias("different_values"))

    @property
    def _key_names(self) -> list[str]:
        return [f"{k} (A)" for k in self.key_a] + [f"{k} (B)" for k in self.key_b]

    @property
    def _cells(self) -> list:
        na, nb = len(self.key_a), len(self.key_b)
        return [((F.col(f"_a{na + i}"), self.a.schema[x].dataType), (F.col(f"_b{nb + i}"), self.b.schema[y].dataType))
                for i, (x, y) in enumerate(self.compare_columns.items())]

    @property
    def _same(self) -> list[Column]:
        return [values_equal(x, y, self.tolerance, self.ignore_case) for x, y in self._cells]

    @property
    def matches(self) -> DataFrame:
        def raw(df: DataFrame, label: str, keys: Sequence[str]) -> Column:
            return F.concat_ws(" ", *[norm_text(F.col(f"_{label}{i}"), df.schema[k].dataType, True)
                                      for i, k in enumerate(keys)])

        identical = raw(self.a, "a", self.key_a) == raw(self.b, "b", self.key_b)
        different = F.col("different_values")
        return self._joined.select(
            (F.col("row_a") + 2).alias("row_in_a_file"), (F.col("row_b") + 2).alias("row_in_b_file"),
            *[col(k) for k in self._key_names], "similarity_pct",
            F.when(identical, "Identical").when(F.col("score") == 100, "Same after cleaning")
            .otherwise("Similar").alias("match_type"),
            F.when(F.col("score") < self.review_below, "Yes").otherwise("").alias("needs_review"),
            F.when(different == 0, "All same").otherwise(F.concat(different.cast("string"), F.lit(" different")))
            .alias("values"))

    @property
    def diffs(self) -> DataFrame:
        labels = [x if x == y else f"{x} <-> {y}" for x, y in self.compare_columns.items()]
        return _difference_rows(self._joined.where("different_values > 0"), [*self._key_names, "similarity_pct"],
                                labels, self._cells, self._same, order=False)

    @cached_property
    def only_a(self) -> DataFrame:
        return self._left_over("a")

    @cached_property
    def only_b(self) -> DataFrame:
        return self._left_over("b")

    @property
    def stats(self) -> DataFrame:
        """One row of counts."""
        names = ["rows_a", "rows_b", "matched_pairs", "needing_review", "with_different_values"]
        one = F.count(F.lit(1))

        def part(df: DataFrame, **made: Column) -> DataFrame:
            return df.agg(*[made.get(n, F.lit(0)).cast("bigint").alias(n) for n in names])

        counted = (part(self.a, rows_a=one).unionAll(part(self.b, rows_b=one)).unionAll(
            part(self._joined, matched_pairs=one, needing_review=F.count_if(F.col("score") < self.review_below),
                 with_different_values=F.count_if(F.col("different_values") > 0))))
        return counted.agg(*[F.sum(n).alias(n) for n in names]).select(
            *names, (F.col("rows_a") - F.col("matched_pairs")).alias("only_in_a"),
            (F.col("rows_b") - F.col("matched_pairs")).alias("only_in_b"))

    def _left_over(self, label: str) -> DataFrame:
        if label == "a":
            return _unmatched(self.a, self.members_a, self.pairs.select(F.col("row_a").alias("row")), self.nodes_a,
                              self.nodes_b, self.edges, "a", self.b, self.key_b, self.method, self.closest_from)
        return _unmatched(self.b, self.members_b, self.pairs.select(F.col("row_b").alias("row")), self.nodes_b,
                          self.nodes_a, self.edges, "b", self.a, self.key_a, self.method, self.closest_from)


fuzzy_compare = FuzzyComparison


def _unmatched(df: DataFrame, members: DataFrame, used: DataFrame, nodes: DataFrame, others: DataFrame,
               edges: DataFrame, label: str, other: DataFrame, other_keys: Sequence[str], method: str,
               floor: int) -> DataFrame:
    mine, theirs = ("id_a", "id_b") if label == "a" else ("id_b", "id_a")
    rows = df.select(F.col(ROW).cast("bigint").alias("row")).join(used, "row", "left_anti")
    left = stable(rows.join(members.select("row", "id"), "row", "left"))
    wanted = left.where("id is not null").select("id").distinct()
    open_nodes = stable(nodes.join(wanted, "id", "left_semi"))
    firsts = others.select(F.col("id").alias(theirs), F.col("first_row").alias("_first"))

    def best(pairs: DataFrame) -> DataFrame:
        """Highest score, then the earliest row of the other table."""
        return (pairs.join(firsts, theirs).groupBy(F.col(mine).alias("id"))
                .agg(F.max(F.struct("score", (-F.col("_first")).alias("_neg"))).alias("_top"))
                .select("id", F.col("_top.score").alias("closest_pct"), (-F.col("_top._neg")).alias("_row_b")))

    found = stable(best(edges.join(wanted.withColumnRenamed("id", mine), mine, "left_semi")))
    # the others have no text at the threshold; they look for the closest below it
    nearest = closest_texts(open_nodes.join(found, "id", "left_anti"), others, method)
    found = found.unionAll(nearest.where(F.col("score") >= floor).select("id", F.col("score").alias("closest_pct"), F.col("row").alias("_row_b")))
    shown = F.concat_ws(" / ", *[F.coalesce(value_text(*typed(other, k)), F.lit("nan")) for k in other_keys])
    texts = other.select(F.col(ROW).cast("bigint").alias("_row_b"), shown.alias("closest"))
    near = found.join(texts, "_row_b").select("id", "closest", "closest_pct")
    found = left.join(near, "id", "left").select(F.col("row").alias("_left"), F.struct("closest", "closest_pct").alias("_near"))
    return (found.join(df.withColumn("_left", F.col(ROW).cast("bigint")), "_left")
            .select((F.col("_left") + 2).alias("row_in_file"), *[col(c) for c in data_columns(df)],
                    "_near.closest", "_near.closest_pct"))
