"""Rules and formula checks. Both only list rows; nothing is removed."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.dates import parse_date
from ..functions.formula import formula
from ..functions.numbers import is_finite, parse_number
from ..functions.text import col, is_date, is_text, norm_text, strip, typed, value_text
from .rows import ROW, file_row
from .stable import stable

PROBLEM_TYPE = "array<struct<column:string,value:string,problem:string>>"


def _today(as_of: dt.date | str | None) -> Column:
    return (F.current_date() if as_of is None else F.lit(str(as_of)).cast("date")).cast("timestamp_ntz")


def row_rule_problems(df: DataFrame, rules: Sequence[Mapping], as_of=None,
                      day_first: bool = True) -> tuple[DataFrame, Column]:
    """The frame with the numbers and dates the rules need, and an array of (column, value, problem) for
    the checks that need only the row itself, NULL where a check holds."""
    found, read = [], {}

    def number(name: str) -> Column:
        read.setdefault(f"_number {name}", parse_number(*typed(df, name)))
        return col(f"_number {name}")

    def moment(name: str) -> Column:
        read.setdefault(f"_date {name}", parse_date(*typed(df, name), day_first))
        return col(f"_date {name}")

    def add(name: str, broken: Column, text: str) -> None:
        c, dtype = typed(df, name)
        entry = F.struct(F.lit(name).alias("column"), value_text(c, dtype).alias("value"),
                         F.lit(text).alias("problem"))
        found.append(F.when(broken, entry))

    for rule in rules:
        name = rule["column"]
        if name not in df.columns:
            continue
        c, dtype = typed(df, name)
        if rule.get("required"):
            add(name, c.isNull() | (strip(c) == "") if is_text(dtype) else c.isNull(), C.PROBLEMS["required"])
        for key in ("min", "max"):
            if key in rule:
                if is_date(dtype):
                    value, bound = c.cast("timestamp_ntz"), F.lit(str(rule[key])).cast("timestamp_ntz")
                else:
                    value, bound = number(name), F.lit(float(rule[key]))
                add(name, value < bound if key == "min" else value > bound, C.PROBLEMS[key].format(rule[key]))
        if "allowed" in rule:
            allowed = [str(x).strip().lower() for x in rule["allowed"]]
            add(name, c.isNotNull() & ~norm_text(c, dtype, True).isin(allowed),
                C.PROBLEMS["allowed"].format(", ".join(map(str, rule["allowed"]))))
        if "pattern" in rule:
            whole = r"\A(?:" + rule["pattern"] + r")\z"
            add(name, c.isNotNull() & ~value_text(c, dtype).rlike(whole),
                C.PROBLEMS["pattern"].format(rule["pattern"]))
        if rule.get("not_future"):
            add(name, moment(name) > _today(as_of), C.PROBLEMS["not_future"])
        other = rule.get("not_after")
        if other is not None and other in df.columns:
            if is_date(dtype) or is_date(typed(df, other)[1]):
                later = moment(name) > moment(other)
            else:
                later = number(name) > number(other)
            add(name, later, C.PROBLEMS["not_after"].format(other))
    if not found:
        return df, F.array().cast(PROBLEM_TYPE)
    return df.select("*", *[c.alias(n) for n, c in read.items()]), F.array(*found)


def list_problems(df: DataFrame, problems: Column, table: str = "A") -> DataFrame:
    return (df.select(file_row(), F.inline(problems)).where("problem is not null")
            .select(F.lit(table).alias("table"), "row_in_file", "column", "value", "problem"))


def repeated_values(df: DataFrame, name: str, table: str = "A") -> DataFrame:
    """All rows whose value, ignoring case and outer spaces, occurs more than once in the column.

    Repeated values are found by a grouped count, kept as a table of their own and met again by a semi join: Spark can
    split the rows of a hot value, as no aggregate on the join key comes with them; no window over a value.
    """
    c, dtype = typed(df, name)
    rows = df.filter(c.isNotNull()).select(file_row(), value_text(c, dtype).alias("value"),
                                           norm_text(c, dtype, True).alias("_k"))
    repeated = stable(rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k"))
    return rows.join(repeated, "_k", "left_semi").select(
        F.lit(table).alias("table"), "row_in_file", F.lit(name).alias("column"), "value",
        F.lit(C.PROBLEMS["unique"]).alias("problem"))


def evaluate_rules(df: DataFrame, rules: Sequence[Mapping], table: str = "A", as_of=None,
                   day_first: bool = True) -> DataFrame:
    """Problem list (table, row_in_file, column, value, problem) of all rules, in one pass over the rows
    plus one grouped count per unique rule. The table carries ``_row``."""
    parts = [repeated_values(df, r["column"], table) for r in rules if r.get("unique") and r["column"] in df.columns]
    if not parts or any(set(r) - {"column", "unique"} for r in rules):
        parts.insert(0, list_problems(*row_rule_problems(df, rules, as_of, day_first), table))
    return reduce(DataFrame.unionAll, parts)


class FormulaChecks(NamedTuple):
    summary: DataFrame
    mismatches: DataFrame


def check_formulas(df: DataFrame, checks: Sequence[Mapping], show: Sequence[str] = (),
                   decimal: str = ".") -> FormulaChecks:
    """Check equations such as ``{"check": "[Amount]", "equals": "[Price] * [Quantity]"}`` on every row.

    A row is checkable when both sides are finite; it mismatches when they differ by more than
    ``tolerance`` (0.01) and, if given, by more than ``tolerance_pct`` percent of the expected value.
    """
    entries = []
    for n, check in enumerate(checks):
        left, right = formula(df, check["check"], decimal), formula(df, check["equals"], decimal)
        name = check.get("name") or f"{check['check']} = {check['equals']}"
        pct = check.get("tolerance_pct")
        entries.append(F.struct(F.lit(n).alias("position"), F.lit(name).alias("check"), left.alias("value"),
                                right.alias("expected"), F.lit(float(check.get("tolerance", 0.01))).alias("_tol"),
                                F.lit(None if pct is None else float(pct)).cast("double").alias("_pct")))
    shown = F.struct(F.lit(0).alias("_"), *[value_text(*typed(df, c)).alias(c) for c in show])
    rows = df.select(file_row(), shown.alias("_shown"), F.inline(F.array(*entries)))
    able = is_finite(F.col("value")) & is_finite(F.col("expected"))
    gap = F.col("value") - F.col("expected")
    wrong = able & (F.abs(gap) > F.col("_tol")) & (
        F.col("_pct").isNull() | (F.abs(gap) > F.abs("expected") * F.col("_pct") / 100))
    rows = rows.withColumn("_able", able).withColumn("_wrong", F.coalesce(wrong, F.lit(False)))
    summary = rows.groupBy("position", "check").agg(
        F.count_if("_able").alias("rows_checked"), F.count_if("_wrong").alias("mismatches"),
        F.count_if(~F.col("_able")).alias("could_not_check"),
        F.bround(F.coalesce(F.sum(F.when(F.col("_wrong"), gap)), F.lit(0.0)), 2).alias("total_difference"))
    mismatches = rows.filter("_wrong").select(
        "check", "row_in_file", *[F.col("_shown")[c].alias(c) for c in show], "value", F.bround("expected", 4).alias("expected"),
        F.bround(gap, 4).alias("difference"),
        F.bround(F.try_divide(gap, F.col("expected")) * 100, 2).alias("difference_pct"))
    # a check has its line even if there is no row to check
    lines = df.sparkSession.createDataFrame([(i, c.get("name") or f"{c['check']} = {c['equals']}") for i, c in enumerate(checks)],
                                            "position int, check string")
    full = lines.join(summary.drop("check"), "position", "left").select("position", "check", *[
        F.coalesce(c, F.lit(0)).alias(c) for c in ("rows_checked", "mismatches", "could_not_check")],
        F.coalesce("total_difference", F.lit(0.0)).alias("total_difference"))
    return FormulaChecks(full.orderBy("position").drop("position"), mismatches)
