"""Data quality check: reports problems, changes nothing.

Everything but the whole-row checks comes from the value table, so the rows are read once and every
distinct value is judged once, weighted by its count.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.dates import parse_date
from ..functions.numbers import parse_number
from ..functions.text import (col, is_marker, norm_text, spelling_key, squeeze, strip, tidy_spaces, typed, value_text,
                              western_digits)
from .candidates import similar_texts
from .clean import settings
from .kinds import column_facts, id_like, per_column
from .quantile import quantiles
from .rows import ROW, data_columns, ensure_rows
from .stable import stable
from .values import value_table

TEXT = T.StringType()

# What is found, how serious it is, its name in the issue list, and what helps.
ISSUES = {
    "empty_column": ("Check", "Column is completely empty", "remove the column or check the source"),
    "empty": ("", "Empty cells", "normal if optional; a required rule lists them"),
    "marker": ("Fix", "Placeholder text that means 'empty'", "empty_markers"),
    "blank": ("Fix", "Cells that contain only spaces", "empty_markers, trim"),
    "spaces": ("Fix", "Extra spaces or invisible characters", "trim"),
    "variants": ("Fix", "value(s) written in different ways (upper/lower case, spaces)", "unify"),
    "number_text": ("Fix", "Numbers stored as text (can't be summed or compared correctly)", "to_number"),
    "bad_number": ("Check", "Values that are not valid numbers", "correct them in the source"),
    "date_text": ("Fix", "Dates stored as text", "to_date"),
    "mixed_dates": ("Check", "Mixed date formats", "to_date reads mixed formats"),
    "ambiguous": ("Check", "Dates that can be read 2 ways (day/month or month/day)", "day_first"),
    "bad_date": ("Check", "Values that are not valid dates", "correct them in the source"),
    "other_decimal": ("Fix", "Numbers written with the other decimal separator", "decimal, to_number"),
    "outlier": ("Check", "Unusually large or small values", "min and max rules"),
    "negative": ("Check", "A few negative values (most are positive)", "a min rule"),
    "future": ("Check", "Dates in the future", "a not_future rule"),
    "old": ("Check", "Very old dates (before 1900) - often typing errors", "correct them in the source"),
    "mixed_types": ("Check", "Mixed value types in one column", "check the column"),
    "repeated_id": ("Check", "Repeated values in an ID/number column", "a unique rule"),
    "constant": ("Info", "Same value in every filled row", "nothing to do"),
    "second_header": ("Check", "Looks like a second column of the same name (duplicate header)", "rename one of them"),
    "typos": ("Check", "Possible typos: pairs of very similar values", "replace; see the similar list"),
    "same_rows": ("Fix", "Identical duplicate rows", "remove_dups"),
    "hidden_rows": ("Fix", "Rows that are duplicates except for spaces/upper-lower case", "clean, then remove_dups"),
}
LEVELS = ["Fix", "Check", "Info"]


class Quality(NamedTuple):
    overview: DataFrame
    issues: DataFrame
    columns: DataFrame
    similar: DataFrame
    duplicates: DataFrame


def similar_values(values: DataFrame, min_score: int = 88, limit: int | None = None) -> DataFrame:
    """Pairs of different values that look like typos of each other, per column.

    From (position, value, n): spellings that differ in case and spaces count as one value. Values need
    four characters, a letter, and the same digits. All values of all columns are compared (by candidate
    join); ``limit`` lists only the best pairs per column.
    """
    tidy = tidy_spaces(F.col("value"))
    counts = values.where("value is not null").groupBy("position", tidy.alias("v")).agg(F.sum("n").alias("n"))
    keyed = counts.groupBy("position", F.lower("v").alias("text")).agg(
        F.min_by("v", F.struct(-F.col("n"), "v")).alias("v"), F.sum("n").alias("n"))
    digits = F.regexp_replace("text", r"[^0-9]", "")
    able = keyed.where((F.length("text") >= 4) & F.col("text").rlike(r"\p{L}"))
    # only values with the same digits can pair up, so column and digits form the block
    able = stable(able.withColumn("block", F.concat_ws(":", F.col("position").cast("string"), digits)))
    # a value alone in its block has no pair
    shared = able.groupBy("block").agg(F.count(F.lit(1)).alias("of")).where("of > 1").select("block")
    nodes = stable(able.join(shared, "block", "left_semi").withColumn("id", F.monotonically_increasing_id()))
    texts = nodes.select("id", "block", "text")
    pairs = similar_texts(texts, texts, min_score, "simple", compact=False, ordered=True)
    one = nodes.select(F.col("id").alias("id_a"), "position", F.col("v").alias("v1"), F.col("n").alias("n1"),
                       F.col("text").alias("t1"))
    two = nodes.select(F.col("id").alias("id_b"), F.col("v").alias("v2"), F.col("n").alias("n2"),
                       F.col("text").alias("t2"))
    first = (F.col("n1") > F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("t1") < F.col("t2")))
    # values are many times their compressed bytes: neither side must be broadcast
    out = pairs.join(one.hint("merge"), "id_a").join(two.hint("merge"), "id_b").select(
        "position", F.when(first, F.col("v1")).otherwise(F.col("v2")).alias("value"),
        F.when(first, F.col("n1")).otherwise(F.col("n2")).alias("count"),
        F.when(first, F.col("v2")).otherwise(F.col("v1")).alias("similar_value"),
        F.when(first, F.col("n2")).otherwise(F.col("n1")).alias("similar_count"),
        F.col("score").alias("similarity_pct"))
    if limit is None:
        return out
    best = W.partitionBy("position").orderBy(F.desc("similarity_pct"), "value", "similar_value")
    return out.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= limit).drop("_k")


def _examples(flagged: DataFrame) -> DataFrame:
    """(position, flag, cells, distinct, examples): counts and the first three values in row order.

    The rank filter keeps three rows per group in every task before anything is shuffled.
    """
    # written, as it is read twice and every value is judged for it
    shown = stable(flagged.groupBy("position", "flag", "shown").agg(F.sum("n").alias("n"), F.min("rank").alias("rank")))
    counts = shown.groupBy("position", "flag").agg(F.sum("n").alias("cells"), F.count(F.lit(1)).alias("distinct"))
    return counts.join(_first_three(shown, ["position", "flag"]), ["position", "flag"])


def _first_three(shown: DataFrame, groups: list[str]) -> DataFrame:
    """The groups with their first three ``shown`` by ``rank`` as ``examples``. Every task keeps three rows per group;
    only those are shuffled."""
    first = W.partitionBy(*groups).orderBy("rank", "shown")
    top = shown.withColumn("_k", F.row_number().over(first)).where("_k <= 3")
    return top.groupBy(*groups).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("_k", "shown"))), lambda x: x["shown"]), " | ").alias("examples"))


def exact_and_hidden_duplicates(df: DataFrame) -> DataFrame:
    """One row: ``exact`` copies beyond the first, and ``hidden`` ones that only case and spaces tell apart."""
    rows = [typed(df, c) for c in data_columns(df)]
    exact = df.groupBy(*[c.alias(f"c{i}") for i, (c, _) in enumerate(rows)]).agg(F.count(F.lit(1)).alias("n"))
    loose = [F.lower(squeeze(value_text(F.col(f"c{i}"), t))).alias(f"k{i}") for i, (_, t) in enumerate(rows)]
    groups = exact.groupBy(*loose).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - F.col("forms")), F.lit(0)).alias("exact"),
                      F.coalesce(F.sum(F.col("forms") - 1), F.lit(0)).alias("hidden"))


def duplicate_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    """All members of groups of rows that are equal apart from case and spaces, with their file row."""
    names = data_columns(df)
    loose = [F.lower(squeeze(value_text(*typed(df, c)))) for c in names]
    keyed = df.withColumn("_key", F.sha2(F.to_json(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(loose)])), 256))
    repeated = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")
    out = keyed.join(repeated, "_key", "left_semi").select((F.col(ROW) + 2).alias("row_in_file"),
                                                           *[col(c) for c in names])
    return out if limit is None else out.orderBy("row_in_file").limit(limit)


def check_quality(df: DataFrame, table: str = "A", cfg: Mapping | None = None, as_of: dt.date | str | None = None,
                  similar_limit: int | None = None, duplicate_limit: int | None = None,
                  typos: bool | Sequence[str] = True) -> Quality:
    """Check one table. ``as_of`` is the day after which dates count as future (default: today).

    ``typos`` names the text columns to search for similar values (True: all): columns of long prose are
    seldom worth it.
    """
    df = ensure_rows(df)
    names = data_columns(df)
    cfg = settings(cfg, names)
    markers, decimal, day_first = [str(m).strip().lower() for m in cfg["empty_markers"]], cfg["decimal"], cfg["day_first"]
    texts = [isinstance(df.schema[c].dataType, T.StringType) for c in names]
    is_text = per_column(texts, "boolean")
    spark = df.sparkSession

    low = F.lower(strip(F.col("value")))
    values = stable(value_table(df).withColumn("marker", F.coalesce(is_text & low.isin(markers), F.lit(False))))
    real = values.where("value is not null and not marker")
    facts = column_facts(df, real, decimal, day_first)
    kind = per_column([f.kind for f in facts], "string")
    numeric = kind.isin("number", "number_text")
    dated = kind.isin("date", "date_text")
    number = F.when(numeric, parse_number(F.col("value"), TEXT, decimal))
    date = F.when(dated, parse_date(F.col("value"), TEXT, day_first))
    parsed = values.withColumn("x", number).withColumn("d", date)

    # quartiles of the numeric columns: one row per column
    bounds = {}
    if any(f.kind in ("number", "number_text") for f in facts):
        kept = parsed.where("value is not null and not marker and x is not null").select("position", "x", "n")
        bounds = {r["position"]: (r["count"], *r["quantiles"]) for r in
                  quantiles(kept, ["position"], "x", [0.25, 0.75], "n").collect()}
    fences = [None] * len(names)
    for p, (count, q1, q3) in bounds.items():
        if q3 - q1 > 0 and count >= 8:
            fences[p] = (q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1))
    lower = per_column([f[0] if f else None for f in fences], "double")
    upper = per_column([f[1] if f else None for f in fences], "double")
    counted = per_column([bounds[i][0] if i in bounds else 0 for i in range(len(names))], "bigint")

    filled = F.col("value").isNotNull() & ~F.col("marker")
    text_cell = is_text & filled
    v, digits = F.col("value"), western_digits(F.col("value"))
    parts = [F.regexp_extract(digits, r"^\s*([0-9]{1,2})[/.-]([0-9]{1,2})[/.-][0-9]{2,4}", i).try_cast("int")
             for i in (1, 2)]
    shape = F.regexp_replace(F.regexp_replace(strip(digits), "[0-9]", "9"), "(?i)[a-z]+", "Mon")
    today = (F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")).cast("timestamp_ntz")
    plain_type = F.when(strip(v).rlike(C.PLAIN_NUMBER), "number").otherwise("text")
    row = F.col("first_row").cast("double")
    day = F.col("d").cast("date").cast("string")
    shown_number = value_text(F.col("x"), T.DoubleType())
    quoted = F.concat(F.lit("'"), v, F.lit("'"))
    other = per_column([f.kind == "text" and f.other_kind == "number_text" for f in facts], "boolean")
    flags = [
        ("empty", v.isNull() | F.col("marker"), F.lit(""), row),
        ("marker", F.col("marker") & (low != ""), v, row),
        ("blank", F.col("marker") & (low == ""), F.lit(""), row),
        ("spaces", text_cell & (tidy_spaces(v) != v), quoted, row),
        ("number_text", text_cell & (kind == "number_text"), v, row),
        ("bad_number", filled & (kind == "number_text") & F.col("x").isNull(), v, row),
        ("date_text", text_cell & (kind == "date_text"), v, row),
        ("mixed_dates", text_cell & (kind == "date_text"), shape, row),
        ("ambiguous", text_cell & (kind == "date_text") & (parts[0] <= 12) & (parts[1] <= 12) & (parts[0] != parts[1]),
         v, row),
        ("bad_date", filled & (kind == "date_text") & F.col("d").isNull(), v, row),
        ("other_decimal", text_cell & other, v, row),
        ("outlier", filled & ((F.col("x") < lower) | (F.col("x") > upper)), shown_number, -F.abs("x")),
        ("negative", filled & (F.col("x") < 0), shown_number, row),
        ("future", filled & (F.col("d") > today), day, row),
        ("old", filled & (F.year("d") < 1900), day, row),
        ("mixed_types", text_cell & ~kind.isin("number_text", "date_text"), plain_type, row),
    ]
    entries = F.array(*[F.when(test, F.struct(F.lit(name).alias("flag"), shown.alias("shown"), rank.alias("rank")))
                        for name, test, shown, rank in flags])
    flagged = parsed.select("position", "n", F.inline(entries)).where("flag is not null")

    # values that agree as normalised text, and values that agree apart from case
    dtype_is_float = per_column([isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) for c in names], "boolean")
    normed = F.when(is_text | dtype_is_float, norm_text(v, TEXT)).otherwise(v)
    distinct = real.groupBy("position", normed.alias("k")).agg(F.sum("n").alias("n"), F.min("first_row").alias("r"),
                                                               F.min_by("value", "first_row").alias("v"))
    distinct = stable(distinct)
    ids = per_column([id_like(c) for c in names], "boolean")
    repeated = distinct.where(ids).groupBy("position", F.lower("k").alias("k")).agg(
        F.sum("n").alias("n"), F.min("r").alias("r"), F.min_by("v", "r").alias("v")).where("n > 1").select(
        "position", "n", F.lit("repeated_id").alias("flag"), F.col("v").alias("shown"), F.col("r").cast("double").alias("rank"))
    single = distinct.groupBy("position").agg(F.count(F.lit(1)).alias("_d"), F.sum("n").alias("n"),
                                              F.min_by("v", "r").alias("shown")).where("_d = 1 and n > 1").select(
        "position", "n", F.lit("constant").alias("flag"), "shown", F.lit(0.0).alias("rank"))

    # typos
    searched = names if typos is True else list(typos or [])
    wanted = [f.kind == "text" and c in searched for c, f in zip(names, facts)]
    pairs = stable(similar_values(real.where(per_column(wanted, "boolean") & is_text)))
    typo_flags = pairs.select("position", F.col("similar_count").alias("n"), F.lit("typos").alias("flag"), F.concat(
        F.lit("'"), "similar_value", F.lit("' ~ '"), "value", F.lit("'")).alias("shown"),
        (-F.col("similarity_pct")).cast("double").alias("rank"))
    found = _examples(reduce(DataFrame.unionByName, [flagged, repeated, single, typo_flags]))

    # spelling variants: keys with several spellings; the example is the first key's spellings
    keyed = real.where(is_text).withColumn("key", spelling_key(tidy_spaces(v)))
    multi = keyed.groupBy("position", "key").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("n")).where("forms > 1")
    variants = multi.groupBy("position").agg(F.sum("n").alias("cells"), F.count(F.lit(1)).alias("distinct"),
                                             F.min("key").alias("key"))
    # one key per column at most
    spelled = keyed.join(F.broadcast(variants.select("position", "key")), ["position", "key"]).withColumn(
        "_k", F.row_number().over(W.partitionBy("position", "key").orderBy("first_row", "value"))).where("_k <= 4")
    spelled = spelled.groupBy("position").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_k", "value"))), lambda x: F.concat(F.lit("'"), x["value"], F.lit("'"))),
        " / ").alias("examples"))
    found = found.unionByName(variants.join(spelled, "position").select(
        "position", F.lit("variants").alias("flag"), "cells", "distinct", "examples"))

    found = stable(found)

    # issue rows
    n_rows = values.where("position = 0").agg(F.sum("n").alias("_rows"))
    total = F.coalesce(F.lit(sum_rows(n_rows)), F.lit(0)).cast("bigint")
    share = F.col("cells") / total
    flag = F.col("flag")
    all_empty = (flag == "empty") & (F.col("cells") == total)
    seconds = [(i, c) for i, c in enumerate(names) if (m := re.match(r"^(.*)\.(\d+)$", c)) and m[1] in names]
    headers = [spark.createDataFrame([(i, "second_header", 0, 0, "")], found.schema) for i, _ in seconds]
    found_all = reduce(DataFrame.unionByName, headers, found)
    keep = (F.when(flag == "blank", F.lit("" in markers))
            .when(flag == "mixed_dates", F.col("distinct") > 1)
            .when(flag == "mixed_types", F.col("distinct") > 1)
            .when(flag == "negative", (F.col("cells") <= F.greatest(F.lit(1.0), 0.05 * counted)) & (counted >= 5))
            .when(flag.isin("marker", "blank", "spaces"), per_column([f.kind != "empty" for f in facts], "boolean"))
            .otherwise(True))
    code = F.when(all_empty, "empty_column").otherwise(flag)
    level_map = F.create_map(*[F.lit(x) for k, (lv, _, _) in ISSUES.items() for x in (k, lv)])
    text_map = F.create_map(*[F.lit(x) for k, (_, tx, _) in ISSUES.items() for x in (k, tx)])
    fix_map = F.create_map(*[F.lit(x) for k, (_, _, fx) in ISSUES.items() for x in (k, fx)])
    order_map = F.create_map(*[F.lit(x) for i, k in enumerate(ISSUES) for x in (k, i)])
    level = F.when(code == "empty", F.when(share < 0.05, "Info").otherwise("Check")).otherwise(level_map[code])
    base = text_map[code]
    problem = (F.when(code == "empty", F.concat(base, F.lit(" ("), F.bround(share * 100, 0).cast("int").cast("string"),
                                                F.lit("%)")))
               .when(code == "variants", F.concat(F.col("distinct").cast("string"), F.lit(" "), base))
               .when(code == "mixed_dates", F.concat(base, F.lit(" ("), F.col("distinct").cast("string"),
                                                     F.lit(" different)")))
               .otherwise(base))
    column_name = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("position") + 1)
    by_column = found_all.where(keep).select("position", column_name.alias("column"), code.alias("code"),
                                             level.alias("level"), problem.alias("problem"), "cells", "examples")
    whole = stable(exact_and_hidden_duplicates(df))
    row_issues = whole.select(F.inline(F.array(*[
        F.struct(F.lit(len(names)).alias("position"), F.lit("(whole row)").alias("column"), F.lit(k).alias("code"),
                 F.lit(ISSUES[k][0]).alias("level"), F.lit(ISSUES[k][1]).alias("problem"), F.col(c).alias("cells"),
                 F.lit("").alias("examples")) for k, c in (("same_rows", "exact"), ("hidden_rows", "hidden"))]))
    ).where("cells > 0")
    every = stable(by_column.unionByName(row_issues))
    rank = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    issues = every.orderBy(rank, "position", order_map[F.col("code")]).select(
        F.lit(table).alias("table"), "column", "level", "code", "problem", "cells", "examples",
        fix_map[F.col("code")].alias("how_to_fix"))

    # one line per column
    counts = every.groupBy("position").agg(F.count(F.lit(1)).alias("issues"))
    sizes = distinct.groupBy("position").agg(F.count(F.lit(1)).alias("distinct"))
    extremes = parsed.where(filled).groupBy("position").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    empties = values.groupBy("position").agg(F.sum(F.when(filled, 0).otherwise(F.col("n"))).alias("empty"))
    # the values of a column are distinct already, so none but the examples is shuffled
    samples = _first_three(values.where(filled).select("position", v.alias("shown"), row.alias("rank")), ["position"])
    lines = spark.createDataFrame([(i, c, C.KIND_LABELS[f.kind], f.filled, f.kind in ("text", "code") or id_like(c))
                                   for i, (c, f) in enumerate(zip(names, facts))],
                                  "position int, column string, label string, filled bigint, maybe_id boolean")
    for part in (counts, sizes, extremes, empties, samples):
        lines = lines.join(part, "position", "left")
    unique = (F.col("distinct") == F.col("filled")) & (F.col("filled") > 1) & F.col("maybe_id")
    zero = F.lit(0).cast("bigint")
    number_edge = lambda c: value_text(F.col(c), T.DoubleType())
    date_edge = lambda c: F.col(c).cast("date").cast("string")
    columns = lines.orderBy("position").select(
        F.lit(table).alias("table"), "column",
        F.when(unique, F.concat("label", F.lit(" - all unique (ID?)"))).otherwise(F.col("label")).alias("type_found"),
        "filled", F.coalesce("empty", zero).alias("empty"),
        F.coalesce(F.bround(100 * F.try_divide(F.col("empty"), total), 1), F.lit(0.0)).alias("empty_pct"),
        F.coalesce("distinct", zero).alias("distinct"), F.coalesce("examples", F.lit("")).alias("examples"),
        F.coalesce(number_edge("x0"), date_edge("d0"), F.lit("")).alias("min"),
        F.coalesce(number_edge("x1"), date_edge("d1"), F.lit("")).alias("max"),
        F.coalesce("issues", zero).alias("issues"))
    if similar_limit is not None:       # a shorter list; the issue counts every pair
        place = F.row_number().over(W.partitionBy("position").orderBy(F.desc("similarity_pct"), "value", "similar_value"))
        pairs = pairs.withColumn("_k", place).where(F.col("_k") <= similar_limit).drop("_k")
    similar = pairs.select(F.lit(table).alias("table"), column_name.alias("column"), "value", "count", "similar_value",
                           "similar_count", "similarity_pct")
    overview = _overview(table, len(names), total, empties, whole, every)
    return Quality(overview, issues, columns, similar, duplicate_rows(df, duplicate_limit))


def sum_rows(one_row: DataFrame) -> int:
    return one_row.first()[0] or 0


def _overview(table: str, width: int, total: Column, empties: DataFrame, whole: DataFrame, every: DataFrame) -> DataFrame:
    def line(i: int, df: DataFrame, item: str, value: Column) -> DataFrame:
        return df.select(F.lit(i).alias("_i"), F.lit(table).alias("table"), F.lit(item).alias("item"),
                         value.cast("bigint").alias("value"))

    facts = empties.agg(F.sum("empty").alias("empty"))
    levels = every.agg(F.count_if(F.col("level") == "Fix").alias("fix"), F.count_if(F.col("level") == "Check").alias("check"))
    out = [line(0, facts, "Rows", total), line(1, facts, "Columns", F.lit(width)),
           line(2, facts, "Empty cells", F.coalesce("empty", F.lit(0))), line(3, whole, "Identical duplicate rows", F.col("exact")),
           line(4, whole, "Hidden duplicates (spaces/case)", F.col("hidden")),
           line(5, levels, "Problems to fix", F.col("fix")), line(6, levels, "Things to check", F.col("check"))]
    return reduce(DataFrame.unionAll, out).orderBy("_i").drop("_i")
