"""Comparing two tables by exact key, two columns, and two rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.equality import difference, values_equal
from ..functions.numbers import plain_number
from ..functions.text import col, is_date, norm_text, typed, value_text
from .rows import ROW, data_columns, find_row
from .values import column_stats, value_table

TEXT = T.StringType()


class Comparison(NamedTuple):
    only_a: DataFrame
    only_b: DataFrame
    matched: DataFrame
    diffs: DataFrame
    stats: DataFrame


def compare_schema(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row per column name: where it exists and with which type. Reads no data."""
    types_a = {f.name: f.dataType.simpleString() for f in a.schema}
    types_b = {f.name: f.dataType.simpleString() for f in b.schema}
    rows = [(i, c, "In both" if c in types_a and c in types_b else "Only in A" if c in types_a else "Only in B",
             types_a.get(c, ""), types_b.get(c, "")) for i, c in enumerate(dict.fromkeys([*types_a, *types_b]))]
    return a.sparkSession.createDataFrame(rows, "position int, column string, status string, type_a string, "
                                                "type_b string")


def _side(df: DataFrame, keys: Sequence[str], names: Sequence[str], columns: Sequence[str], ignore_case: bool,
          label: str) -> DataFrame:
    normed = [norm_text(*typed(df, k), ignore_case).alias(n) for k, n in zip(keys, names)]
    cells = [typed(df, c)[0].alias(f"_{label}{i}") for i, c in enumerate(columns)]
    return df.select(*normed, *cells)


def common_columns(a: DataFrame, b: DataFrame, skip: Sequence[str] = ()) -> dict[str, str]:
    return {c: c for c in data_columns(a) if c in b.columns and c not in skip}


def exact_compare(a: DataFrame, b: DataFrame, key_a: Sequence[str], key_b: Sequence[str],
                  columns: Mapping[str, str] | None = None, tolerance: float = 0.0,
                  ignore_case: bool = False) -> Comparison:
    """Reconcile two tables by key. Keys compare as normalised text, so ``1001``, ``1001.0`` and
    ``' 1001'`` match and missing keys match each other; repeated keys pair up with each other.

    The matched rows are an inner join and the one-sided rows anti joins against distinct keys, since
    those are the joins whose hot keys Spark can split at run time (a full outer join is not). The
    counts come from keys counted per side before any shuffle, without a join.
    """
    if len(key_a) != len(key_b) or not key_a:
        raise ValueError("both tables need the same number of key columns, at least one")
    if columns is None:
        columns = common_columns(a, b, [*key_a, *key_b])
    pairs = [(ca, cb) for ca, cb in columns.items() if ca not in key_a]
    keys = list(key_a)
    left = _side(a, key_a, keys, [x for x, _ in pairs], ignore_case, "a")
    right = _side(b, key_b, keys, [y for _, y in pairs], ignore_case, "b")
    key_cols = [col(k) for k in keys]

    def restore(df: DataFrame, label: str) -> DataFrame:
        return df.select(*key_cols, *[F.col(f"_{label}{i}").alias(x) for i, (x, _) in enumerate(pairs)])

    only_a = restore(left.join(right.select(*key_cols).distinct(), keys, "left_anti"), "a")
    only_b = restore(right.join(left.select(*key_cols).distinct(), keys, "left_anti"), "b")

    cells = [((F.col(f"_a{i}"), a.schema[x].dataType), (F.col(f"_b{i}"), b.schema[y].dataType))
             for i, (x, y) in enumerate(pairs)]
    same = [values_equal(x, y, tolerance, ignore_case) for x, y in cells]
    changed = reduce(lambda p, q: p | q, [~s for s in same], F.lit(False))
    joined = left.join(right, keys)
    matched = joined.select(*key_cols, *[c for i, (x, _) in enumerate(pairs) for c in (
        F.col(f"_a{i}").alias(f"{x} (A)"), F.col(f"_b{i}").alias(f"{x} (B)"))], changed.alias("changed"))
    diffs = _difference_rows(joined.filter(changed), keys, [x for x, _ in pairs], cells, same)

    # counts: one row per key and side, summed before the shuffle
    n_a, n_b = F.sum("_in_a").alias("n_a"), F.sum("_in_b").alias("n_b")
    marked = (left.select(*key_cols, F.lit(1).cast("bigint").alias("_in_a"), F.lit(0).cast("bigint").alias("_in_b"))
              .unionAll(right.select(*key_cols, F.lit(0).cast("bigint").alias("_in_a"),
                                     F.lit(1).cast("bigint").alias("_in_b"))))
    per_key = marked.groupBy(*key_cols).agg(n_a, n_b)
    zero = F.lit(0).cast("bigint")
    counts = per_key.agg(
        F.sum("n_a").alias("rows_a"), F.sum("n_b").alias("rows_b"), F.sum(F.col("n_a") * F.col("n_b")).alias("matched"),
        zero.alias("matched_changed"),
        F.sum(F.when(F.col("n_b") == 0, F.col("n_a"))).alias("only_a"),
        F.sum(F.when(F.col("n_a") == 0, F.col("n_b"))).alias("only_b"),
        F.sum(F.when(F.col("n_a") > 1, F.col("n_a") - 1)).alias("dup_a"),
        F.sum(F.when(F.col("n_b") > 1, F.col("n_b") - 1)).alias("dup_b"))
    # equal pairs: rows that agree in key and values are counted per side, again before the shuffle
    if tolerance == 0:
        shared = [f"_v{i}" for i in range(len(cells))]

        def canon(df: DataFrame, on_a: bool) -> DataFrame:
            values = [_canonical(x if on_a else y, y[1] if on_a else x[1], ignore_case).alias(s)
                      for s, (x, y) in zip(shared, cells)]
            return df.select(*key_cols, *values, F.lit(int(on_a)).cast("bigint").alias("_in_a"),
                             F.lit(int(not on_a)).cast("bigint").alias("_in_b"))

        equal = (canon(left, True).unionAll(canon(right, False)).groupBy(*key_cols, *shared).agg(n_a, n_b)
                 .agg(F.sum(F.col("n_a") * F.col("n_b")).alias("_equal")))
        pair_changes = equal.select((-F.col("_equal")).alias("matched_changed"))
        changes_start = F.col("matched")
    else:
        grouped_a = left.groupBy(*left.columns).agg(F.count(F.lit(1)).alias("_na"))
        grouped_b = right.groupBy(*right.columns).agg(F.count(F.lit(1)).alias("_nb"))
        pair_changes = grouped_a.join(grouped_b, keys).filter(changed).agg(
            F.sum(F.col("_na") * F.col("_nb")).alias("matched_changed"))
        changes_start = zero
    counts = counts.withColumn("matched_changed", changes_start)
    names = counts.columns
    both = counts.unionByName(pair_changes.select(
        *[(F.col("matched_changed") if c == "matched_changed" else zero).alias(c) for c in names]))
    stats = both.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in names])
    return Comparison(only_a, only_b, matched, diffs, stats)


def _canonical(cell, other: T.DataType, ignore_case: bool):
    """Text that two cells share exactly when `values_equal` holds at tolerance 0 (NULL for no value)."""
    c, dtype = cell
    if is_date(dtype) and is_date(other):
        return c.cast("timestamp_ntz").cast("string")
    text = F.concat(F.lit("t"), norm_text(c, dtype, ignore_case))
    if not (is_date(dtype) or is_date(other)):
        number = plain_number(c, dtype)
        text = F.when(number.isNotNull(), F.concat(F.lit("n"), (number + 0.0).cast("string"))).otherwise(text)
    return F.when(c.isNotNull(), text)


def compare_tables(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None,
                   tolerance: float = 0.0, ignore_case: bool = False) -> Comparison:
    """`exact_compare` for tables that share their column names."""
    named = None if columns is None else {c: c for c in columns}
    return exact_compare(a, b, keys, keys, named, tolerance, ignore_case)


def _difference_rows(df: DataFrame, keep: Sequence[str], labels: Sequence[str], cells: Sequence, same: Sequence,
                     order: bool = True) -> DataFrame:
    """Long form of differing cells: one row per (row, column) that is not equal."""
    entries = [F.struct(F.lit(i).alias("position"), F.lit(label).alias("column"), value_text(*x).alias("value_a"),
                        value_text(*y).alias("value_b"), difference(x, y).alias("difference"), s.alias("_same"))
               for i, (label, (x, y), s) in enumerate(zip(labels, cells, same))]
    if not entries:
        entries = [F.struct(F.lit(0).alias("position"), F.lit("").alias("column"), F.lit("").alias("value_a"),
                            F.lit("").alias("value_b"), F.lit(0.0).alias("difference"), F.lit(True).alias("_same"))]
    kept = [col(k) for k in keep]
    rows = (df.select(*kept, F.explode(F.array(*entries)).alias("_cell")).filter("not _cell._same")
            .select(*kept, "_cell.position", "_cell.column", "_cell.value_a", "_cell.value_b", "_cell.difference"))
    rows = rows.orderBy(*kept, "position") if order else rows
    return rows.drop("position")


def key_warning(stats: DataFrame) -> DataFrame:
    """A text row when either side repeats keys."""
    text = F.concat(F.lit("Key not unique (duplicates A="), F.col("dup_a"), F.lit(", B="), F.col("dup_b"), F.lit(")"))
    return stats.where("dup_a > 0 or dup_b > 0").select(text.alias("warning"))


# ---------------------------------------------------------------- columns
class Overlap(NamedTuple):
    both: DataFrame
    only_a: DataFrame
    only_b: DataFrame
    counts: DataFrame


def value_overlap(a: DataFrame, column_a: str, b: DataFrame, column_b: str, ignore_case: bool = False) -> Overlap:
    """Distinct normalised values found in both columns, only in A, only in B, and their counts."""
    def side(df: DataFrame, name: str, label: str) -> DataFrame:
        c, dtype = typed(df, name)
        return (df.filter(c.isNotNull())
                .select(norm_text(c, dtype, ignore_case).alias("value"), F.lit(label == "a").alias("a"),
                        F.lit(label == "b").alias("b")))

    merged = side(a, column_a, "a").unionAll(side(b, column_b, "b")).groupBy("value").agg(
        F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    parts = [merged.filter(c).select("value").orderBy("value") for c in ("a and b", "a and not b", "b and not a")]
    counts = merged.agg(F.count_if(F.col("a") & F.col("b")).alias("both"),
                        F.count_if(F.col("a") & ~F.col("b")).alias("only_a"),
                        F.count_if(~F.col("a") & F.col("b")).alias("only_b"))
    return Overlap(*parts, counts)


def rowwise_compare(a: DataFrame, column_a: str, b: DataFrame, column_b: str, tolerance: float = 0.0,
                    ignore_case: bool = False) -> DataFrame:
    """Row i of one column against row i of another, up to the shorter table (tables carry ``_row``)."""
    x, y = typed(a, column_a), typed(b, column_b)
    left = a.select(F.col(ROW).alias("row"), x[0].alias("value_a"))
    right = b.select(F.col(ROW).alias("row"), y[0].alias("value_b"))
    cells = (F.col("value_a"), x[1]), (F.col("value_b"), y[1])
    return left.join(right, "row").select("row", "value_a", "value_b",
                                          values_equal(*cells, tolerance, ignore_case).alias("same"),
                                          difference(*cells).alias("difference"))


# The metrics of a column profile, in order.
METRICS = ["Rows", "Empty", "Distinct values", "Earliest", "Latest", "Sum", "Average", "Min", "Max", "Most common"]


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: rows, empty, distinct, then earliest/latest for dates, sum/average/min/max when
    at least 80 % of the values are plain numbers, else the most common value (ties: the smallest)."""
    return column_stats(df, value_table(df))


def column_profile(df: DataFrame, column: str) -> DataFrame:
    """The profile of one column as (position, metric, value) rows; metrics that do not apply are absent."""
    p = profile_columns(df.select(col(column)))
    text = {"Rows": F.col("rows"), "Empty": F.col("empty"), "Distinct values": F.col("distinct"),
            "Earliest": F.col("earliest"), "Latest": F.col("latest"), "Sum": F.bround("sum", 4),
            "Average": F.bround("average", 4), "Min": F.col("min"), "Max": F.col("max"),
            "Most common": F.col("most_common")}
    rows = [F.struct(F.lit(i).alias("position"), F.lit(m).alias("metric"),
                     value_text(text[m], T.DoubleType() if m in ("Sum", "Average", "Min", "Max") else TEXT)
                     .cast("string").alias("value")) for i, m in enumerate(METRICS)]
    return p.select(F.inline(F.array(*rows))).where("value is not null")


def compare_columns(a: DataFrame, column_a: str, b: DataFrame, column_b: str) -> DataFrame:
    """Two column profiles side by side."""
    pa = column_profile(a, column_a).withColumnRenamed("value", "value_a")
    pb = column_profile(b, column_b).withColumnRenamed("value", "value_b")
    return pa.join(pb, ["position", "metric"], "full_outer").orderBy("position").drop("position")


# ---------------------------------------------------------------- rows
def compare_rows(a: DataFrame, by_a: str, value_a, b: DataFrame, by_b: str, value_b,
                 pairs: Mapping[str, str] | None = None, ignore_case: bool = True,
                 tolerance: float = 0.0) -> DataFrame:
    """The cells of one row of A next to those of one row of B: same-named columns and extra pairs."""
    mapping = {c: c for c in data_columns(a) if c in b.columns}
    mapping.update({x: y for x, y in (pairs or {}).items() if x in a.columns and y in b.columns})

    def cells(row: DataFrame, source: DataFrame, names: Sequence[str], label: str) -> DataFrame:
        entries = [F.struct(F.lit(i).alias("position"), value_text(*typed(source, c)).alias(label))
                   for i, c in enumerate(names)]
        return row.select(F.inline(F.array(*entries)))

    left = cells(find_row(a, by_a, value_a), a, list(mapping), "row_a")
    right = cells(find_row(b, by_b, value_b), b, list(mapping.values()), "row_b")
    names = F.array(*[F.lit(x if x == y else f"{x} <-> {y}") for x, y in mapping.items()])
    same = values_equal((F.col("row_a"), TEXT), (F.col("row_b"), TEXT), tolerance, ignore_case)
    return (left.join(right, "position").orderBy("position")
            .select(F.element_at(names, F.col("position") + 1).alias("column"), "row_a", "row_b", same.alias("same")))


def row_compare_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count(F.lit(1)).alias("compared_columns"),
                        F.count_if(~F.col("same")).alias("columns_that_differ"))


def column_compare_summary(overlap: Overlap, rowwise: DataFrame) -> DataFrame:
    """Counts of shared and one-sided values, and of rows that differ by position, as (item, value)."""
    counts = overlap.counts.select(F.inline(F.array(
        *[F.struct(F.lit(i).alias("item"), F.col(c).alias("value"))
          for i, c in (("Values in both", "both"), ("Values only in A", "only_a"), ("Values only in B", "only_b"))])))
    differing = rowwise.agg(F.lit("Rows that differ (by position)").alias("item"),
                            F.count_if(~F.col("same")).alias("value"))
    return counts.unionAll(differing)
