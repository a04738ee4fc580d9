"""Cleaning a table, with a log of every change.

What to do depends on the data (which columns hold dates, which spelling is most common), so cleaning has
two phases: the value table of the text columns is aggregated into a few figures per column and a table of
spelling corrections; then one lazy projection cleans the rows. The log is an aggregate over the value
table, where every distinct value carries its count and first row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.dates import parse_date
from ..functions.numbers import parse_number, plain_number
from ..functions.text import (col, is_marker, is_text, letter_case, replace_values, spelling_key, tidy_spaces, typed,
                              value_text)
from .kinds import column_facts, whole_columns
from .rows import ROW, data_columns, ensure_rows
from .rules import PROBLEM_TYPE, list_problems, repeated_values, row_rule_problems
from .stable import broadcast_if_small, stable
from .values import column_names, value_table

TEXT = T.StringType()
LOG = ["table", "step", "column", "cells_changed", "example_before", "example_after", "note"]

# The default settings.
DEFAULTS = {
    "empty_markers": C.EMPTY_MARKERS, "trim": True, "unify": True, "to_number": "auto", "decimal": ".",
    "to_date": "auto", "day_first": True, "fix_case": {}, "replace": {}, "remove_dups": True, "merge": {},
    "rules": [],
}

# Names of the cleaning steps in the log.
STEPS = {
    "marker": "Placeholder -> empty",
    "trim": "Trimmed spaces / invisible characters",
    "replace": "Replaced values (REPLACE_VALUES)",
    "case": "Case -> {}",
    "unify": "Unified spelling variants (case/spaces)",
    "date": "Text -> date",
    "number": "Text -> number",
    "dups": "Removed identical duplicate rows",
    "merge": "Merged rows with the same key",
}


class Cleaned:
    """The cleaned rows, the log of changes (worked out when asked for) and the data problems."""

    def __init__(self, data: DataFrame, make_log: Callable[[], DataFrame], problems: DataFrame):
        self.data, self._make_log, self.problems = data, make_log, problems

    @cached_property
    def log(self) -> DataFrame:
        return self._make_log()


def settings(cfg: Mapping | None, columns: Sequence[str]) -> dict:
    """The settings with defaults filled in, checked against the known columns."""
    out = {**DEFAULTS, **(cfg or {})}

    def need(names, what: str) -> None:
        missing = [n for n in names if n not in columns]
        if missing:
            raise ValueError(f"{what}: no such columns {missing}; columns: {list(columns)}")

    for key in ("to_number", "to_date"):
        if isinstance(out[key], (list, tuple)):
            need(out[key], key)
        elif out[key] != "auto":
            raise ValueError(f'{key} is "auto" or a list of columns')
    if out["decimal"] not in (".", ","):
        raise ValueError('decimal is "." or ","')
    for key in ("fix_case", "replace"):
        if not isinstance(out[key], Mapping):
            raise ValueError(f"{key} maps columns to settings")
        need(out[key], key)
    if any(m not in C.LETTER_CASES for m in out["fix_case"].values()):
        raise ValueError(f"fix_case uses {C.LETTER_CASES}")
    if any(not isinstance(m, Mapping) for m in out["replace"].values()):
        raise ValueError("replace maps a column to {old: new}")
    if out["merge"]:
        if not isinstance(out["merge"].get("key"), (list, tuple)) or not out["merge"]["key"]:
            raise ValueError('merge needs a list of columns under "key"')
        need(out["merge"]["key"], "merge key")
        need(out["merge"].get("how", {}), "merge how")
        if any(h not in C.MERGE_WAYS for h in out["merge"].get("how", {}).values()):
            raise ValueError(f"merge how uses {C.MERGE_WAYS}")
    if not isinstance(out["rules"], (list, tuple)):
        raise ValueError("rules is a list")
    for i, rule in enumerate(out["rules"], 1):
        checks = set(rule) - {"column"} if isinstance(rule, Mapping) and "column" in rule else set()
        if not checks or checks - set(C.RULE_CHECKS):
            raise ValueError(f"rule {i} needs a column and checks out of {C.RULE_CHECKS}")
        need([rule["column"], *([rule["not_after"]] if "not_after" in rule else [])], f"rule {i}")
        if "pattern" in rule:
            re.compile(rule["pattern"])
    return out


def restricted(cfg: Mapping | None, columns: Sequence[str]) -> dict:
    """The settings that concern the given columns; those that name columns of another table are left out."""
    out = dict(cfg or {})
    for key in ("to_number", "to_date"):
        if isinstance(out.get(key), (list, tuple)):
            out[key] = [c for c in out[key] if c in columns]
    for key in ("fix_case", "replace"):
        if isinstance(out.get(key), Mapping):
            out[key] = {c: v for c, v in out[key].items() if c in columns}
    if out.get("merge"):
        merge = out["merge"]
        whole = all(c in columns for c in merge["key"])
        out["merge"] = {"key": merge["key"], "how": {c: h for c, h in merge.get("how", {}).items() if c in columns}} if whole else {}
    out["rules"] = [r for r in out.get("rules", ()) if all(c in columns for c in (r["column"], r.get("not_after", r["column"])))]
    return out


def _stages(c: Column, name: str, cfg: Mapping) -> list[tuple[str, Column]]:
    """The row-local steps of one text column in order: (step, value after it)."""
    out = []
    if cfg["empty_markers"]:
        c = F.when(~is_marker(c, cfg["empty_markers"]), c)
        out.append((STEPS["marker"], c))
    if cfg["trim"]:
        c = tidy_spaces(c)
        out.append((STEPS["trim"], c))
    if name in cfg["replace"]:
        c = replace_values(c, cfg["replace"][name])
        out.append((STEPS["replace"], c))
    if name in cfg["fix_case"]:
        c = letter_case(c, cfg["fix_case"][name])
        out.append((STEPS["case"].format(cfg["fix_case"][name]), c))
    return out


def spelling_corrections(values: DataFrame) -> DataFrame:
    """(position, value, canon) for values whose spelling, apart from case and spaces, is not the most
    common one of their kind (ties: the smallest). ``values`` is (position, value, n)."""
    counts = values.where("value is not null").groupBy("position", "value").agg(F.sum("n").alias("n")).withColumn(
        "key", spelling_key(F.col("value")))
    # the values are distinct here, so a window holds the spellings of one key; no join of all values with themselves
    same = W.partitionBy("position", "key")
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("value").alias("canon"))).over(same)
    return counts.withColumn("best", best).where(F.col("value") != F.col("best.canon")).select("position", "value", "best.canon")


def unify_spelling(df: DataFrame, column: str) -> DataFrame:
    """Replace spelling variants (case, spaces) in one column by the most common spelling."""
    position = data_columns(df).index(column)
    fixes = stable(spelling_corrections(value_table(df, [column])))
    return _apply_corrections(df, fixes, position, column)


def _apply_corrections(df: DataFrame, fixes: DataFrame, position: int, column: str) -> DataFrame:
    mine = fixes.where(F.col("position") == position).select(F.col("value").alias("_old"), F.col("canon").alias("_new"))
    joined = df.join(broadcast_if_small(mine), col(column) == F.col("_old"), "left")
    return joined.select(*[F.coalesce(F.col("_new"), col(c)).alias(c) if c == column else col(c) for c in df.columns])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Keep the first of identical rows. Copies collapse before the shuffle, however many there are."""
    names = data_columns(df)
    kept = df.groupBy(*[typed(df, c)[0].alias(c) for c in names]).agg(F.min(ROW).alias(ROW))
    return kept.select(*[col(c) for c in df.columns])


def merge_rows(df: DataFrame, key: Sequence[str], how: Mapping[str, str] | None = None) -> DataFrame:
    """One row per key. Columns without a setting keep their first non-empty value in row order; missing
    keys form a group; the merged row takes the place of the group's first row.

    All ways combine partially before the shuffle. ``join`` first reduces to distinct texts per key.
    """
    how = dict(how or {})
    keys = [col(k) for k in key]
    aggs, joins = [F.min(ROW).alias(ROW)], []
    for name in data_columns(df):
        if name in key:
            continue
        way = how.get(name, "first")
        c, dtype = typed(df, name)
        place = F.when(c.isNotNull(), F.col(ROW))
        if way == "join":
            joins.append(name)
            continue
        made = {"first": lambda: F.min_by(c, place), "last": lambda: F.max_by(c, place),
                "sum": lambda: F.coalesce(F.sum(plain_number(c, dtype)), F.lit(0.0)),
                "mean": lambda: F.avg(plain_number(c, dtype)), "min": lambda: F.min(c), "max": lambda: F.max(c),
                "count": lambda: F.count(c)}[way]()
        aggs.append(made.alias(name))
    out = df.groupBy(*keys).agg(*aggs)
    for name in joins:
        text = value_text(*typed(df, name))
        firsts = df.where(text.isNotNull()).groupBy(*keys, text.alias("_t")).agg(F.min(ROW).alias("_r"))
        in_order = F.array_sort(F.collect_list(F.struct("_r", "_t")))
        lists = firsts.groupBy(*[col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(
            F.array_join(F.transform(in_order, lambda x: x["_t"]), ", ").alias(name))
        same = [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
        out = out.join(lists, same, "left").drop(*[f"_k{i}" for i in range(len(key))])
    return out.select(*[col(c) for c in df.columns])


def clean_table(df: DataFrame, cfg: Mapping | None = None, table: str = "A", as_of=None) -> Cleaned:
    """Clean one table: placeholders, spaces, replacements, letter case, spelling variants, dates and
    numbers stored as text, then rules (listed before duplicates go), duplicates and merging by key."""
    df = ensure_rows(df)
    names = data_columns(df)
    cfg = settings(cfg, names)
    text_names = [c for c in names if is_text(df.schema[c].dataType)]
    stages = {c: _stages(col(c), c, cfg) for c in text_names}

    # phase 1: figures per column and spelling corrections, from the distinct values
    before = stable(value_table(df, text_names)) if text_names else None
    whole_at, kinds, fixes, staged = set(), {}, None, None
    unify = text_names if cfg["unify"] is True else [c for c in (cfg["unify"] or []) if c in text_names]
    if text_names:
        staged = _staged(before, names, text_names, cfg)
        last = F.element_at("steps", -1)["value"]
        current = staged.select("position", last.alias("value"), "n")
        if unify:
            wanted = current.where(F.col("position").isin([names.index(c) for c in unify]))
            fixes = stable(spelling_corrections(wanted))
            current = current.join(broadcast_if_small(fixes), ["position", "value"], "left").select(
                "position", F.coalesce("canon", "value").alias("value"), "n")
        if "auto" in (cfg["to_date"], cfg["to_number"]):
            facts = column_facts(df, current, cfg["decimal"], cfg["day_first"])
            kinds = {c: facts[names.index(c)].kind for c in text_names}
            whole_at = {i for i, f in enumerate(facts) if f.whole}
        else:       # what the columns hold has been said; only whole numbers are still looked for
            asked = [names.index(c) for c in cfg["to_number"] if c in text_names and c not in cfg["to_date"]]
            whole_at = whole_columns(current, asked, cfg["decimal"]) if asked else set()
    dates = ([c for c in text_names if kinds[c] == "date_text"] if cfg["to_date"] == "auto"
             else [c for c in cfg["to_date"]])
    numbers = ([c for c in text_names if kinds[c] == "number_text"] if cfg["to_number"] == "auto"
               else [c for c in cfg["to_number"] if c not in dates])

    # phase 2: one projection over the rows
    local = df.select(*[stages[c][-1][1].alias(c) if stages.get(c) else col(c) for c in names], ROW)
    if fixes is not None:
        for p in [r["position"] for r in fixes.select("position").distinct().collect()]:
            local = _apply_corrections(local, fixes, p, names[p])
    whole = [c for c in numbers if c in text_names and names.index(c) in whole_at]
    values, unread = {}, []
    for c in dates:
        raw, dtype = typed(local, c)
        values[c] = parse_date(raw, dtype, cfg["day_first"])
        unread.append((c, raw, dtype, values[c], "bad_date"))
    for c in numbers:
        raw, dtype = typed(local, c)
        parsed = parse_number(raw, dtype, cfg["decimal"])
        values[c] = parsed.cast("bigint") if c in whole else parsed
        unread.append((c, raw, dtype, parsed, "bad_number"))
    failed = [F.when(raw.isNotNull() & made.isNull(), F.struct(
        F.lit(c).alias("column"), value_text(raw, dtype).alias("value"), F.lit(C.PROBLEMS[what]).alias("problem")))
        for c, raw, dtype, made, what in unread]
    failures = F.array(*failed) if failed else F.array().cast(PROBLEM_TYPE)
    data = local.select(*[values.get(c, col(c)).alias(c) for c in names], ROW, failures.alias("_failures"))
    judged, checks = row_rule_problems(data, cfg["rules"], as_of, cfg["day_first"])
    problems = list_problems(judged, F.concat(F.col("_failures"), checks), table)
    data = data.drop("_failures")
    for rule in cfg["rules"]:
        if rule.get("unique"):
            problems = problems.unionAll(repeated_values(data, rule["column"], table))

    logs = [lambda: _value_log(staged, fixes, df, names, [c for c in dates if c in text_names],
                               [c for c in numbers if c in text_names], whole, cfg, table)]
    if cfg["remove_dups"]:
        logs.append(lambda rows=data: _duplicate_log(rows, table))
        data = drop_duplicate_rows(data)
    if cfg["merge"]:
        merged = merge_rows(data, cfg["merge"]["key"], cfg["merge"].get("how"))
        logs.append(lambda rows=data: _merge_log(rows, merged, cfg["merge"], table))
        data = merged
    return Cleaned(data, lambda: reduce(DataFrame.unionAll, [made() for made in logs]), problems)


def _staged(before: DataFrame, names: list[str], text_names: list[str], cfg: Mapping) -> DataFrame:
    """The value table with the value after every row-local step, each distinct value worked once."""
    def steps_of(name: str) -> Column:
        stages = [("", F.col("value")), *_stages(F.col("value"), name, cfg)]
        return F.array(*[F.struct(F.lit(s).alias("step"), v.alias("value")) for s, v in stages])

    steps = steps_of("")
    for c in text_names:
        if c in cfg["replace"] or c in cfg["fix_case"]:
            steps = F.when(F.col("position") == names.index(c), steps_of(c)).otherwise(steps)
    return before.select("position", "n", "first_row", steps.alias("steps"))


def _value_log(staged, fixes, df, names, dates, numbers, whole, cfg, table) -> DataFrame:
    """One log row per step and column that changed something, with the first change as the example."""
    spark = df.sparkSession
    if staged is None:
        return spark.createDataFrame([], "table string, step string, column string, cells_changed bigint, "
                                         "example_before string, example_after string, note string")
    v = staged.withColumn("_last", F.element_at("steps", -1)["value"])
    if fixes is not None:
        v = v.join(broadcast_if_small(fixes.withColumnRenamed("value", "_last")), ["position", "_last"], "left")
        v = v.withColumn("_unified", F.coalesce("canon", "_last"))
    else:
        v = v.withColumn("_unified", F.col("_last"))
    is_dated = F.col("position").isin([names.index(c) for c in dates]) if dates else F.lit(False)
    is_counted = F.col("position").isin([names.index(c) for c in numbers]) if numbers else F.lit(False)
    date = parse_date(F.col("_unified"), TEXT, cfg["day_first"])
    number = parse_number(F.col("_unified"), TEXT, cfg["decimal"])

    def change(step, old, new, forced=None, failed=None) -> Column:
        return F.struct(step.alias("step"), old.alias("before"), new.alias("after"),
                        (F.lit(False) if forced is None else forced).alias("typed"),
                        (F.lit(False) if failed is None else failed).alias("failed"))

    local = F.zip_with(F.slice("steps", F.lit(1), F.size("steps") - 1), F.slice("steps", F.lit(2), F.size("steps") - 1),
                       lambda x, y: change(y["step"], x["value"], y["value"]))
    number_text = value_text(number, T.DoubleType())
    if whole:
        number_text = F.when(F.col("position").isin([names.index(c) for c in whole]),
                             F.regexp_replace(number_text, r"\.0$", "")).otherwise(number_text)
    late = F.array(change(F.lit(STEPS["unify"]), F.col("_last"), F.col("_unified")),
                   change(F.lit(STEPS["date"]), F.when(is_dated, F.col("_unified")),
                          value_text(F.when(is_dated, date), T.TimestampNTZType()), is_dated,
                          is_dated & F.col("_unified").isNotNull() & date.isNull()),
                   change(F.lit(STEPS["number"]), F.when(is_counted, F.col("_unified")),
                          F.when(is_counted, number_text), is_counted,
                          is_counted & F.col("_unified").isNotNull() & number.isNull()))
    rows = v.select("position", "n", "first_row", F.posexplode(F.concat(local, late)).alias("_step", "_c")).select(
        "position", "n", "first_row", "_step", "_c.*")
    changed = F.when(F.col("typed"), F.col("before").isNotNull()).otherwise(~F.col("before").eqNullSafe(F.col("after")))
    log = rows.where(changed).groupBy("step", "position").agg(
        F.min("_step").alias("_step"), F.sum("n").alias("cells_changed"),
        F.min_by("before", "first_row").alias("_before"), F.min_by("after", "first_row").alias("example_after"),
        F.sum(F.when(F.col("failed"), F.col("n")).otherwise(0)).alias("_failed"))
    note = F.when(F.col("_failed") > 0, F.concat(F.col("_failed").cast("string"), F.lit(
        " value(s) could not be read - see Data problems"))).otherwise(F.lit(""))
    return log.orderBy("_step", "position").select(
        F.lit(table).alias("table"), "step", column_names(df).alias("column"), "cells_changed",
        F.concat(F.lit("'"), F.col("_before"), F.lit("'")).alias("example_before"), "example_after", note.alias("note"))


def _duplicate_log(data: DataFrame, table: str) -> DataFrame:
    """Number of removed copies and the first 15 of them."""
    cells = [typed(data, c)[0] for c in data_columns(data)]
    names = [f"_c{i}" for i in range(len(cells))]
    rows = data.select(F.xxhash64(*cells).alias("_h"), *[c.alias(n) for c, n in zip(cells, names)], col(ROW).alias("_r"))
    groups = stable(rows.groupBy("_h", *names).agg(F.min("_r").alias("_first"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1"))
    # only the rows of repeated ones are looked up again
    held = groups.select(F.col("_h").alias("_g"), "_first", *[F.col(n).alias(f"{n}_") for n in names])
    same = [F.col("_h") == F.col("_g"), *[F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]]
    gone = rows.join(held, same).where("_r > _first").select(F.col("_r").alias(ROW))
    first = gone.orderBy(ROW).limit(15).agg(F.lit(None).cast("bigint").alias("n"), F.array_join(
        F.transform(F.array_sort(F.collect_list(ROW)), lambda r: (r + 2).cast("string")), ", ").alias("rows"))
    total = groups.agg(F.sum(F.col("_copies") - 1).alias("n"), F.lit(None).cast("string").alias("rows"))
    both = total.unionAll(first).agg(F.max("n").alias("n"), F.max("rows").alias("rows")).where("n > 0")
    more = F.when(F.col("n") > 15, F.lit(" ...")).otherwise(F.lit(""))
    return both.select(F.lit(table).alias("table"), F.lit(STEPS["dups"]).alias("step"),
                       F.lit("(whole row)").alias("column"), F.col("n").alias("cells_changed"),
                       F.concat(F.lit("rows "), F.col("rows"), more).alias("example_before"),
                       F.lit("removed").alias("example_after"), F.lit("Kept the first copy of each").alias("note"))


def _merge_log(data: DataFrame, merged: DataFrame, merge: Mapping, table: str) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    one = F.count(F.lit(1))
    sizes = data.agg(one.alias("b"), zero.alias("a")).unionAll(merged.agg(zero, one)).agg(
        F.sum("b").alias("b"), F.sum("a").alias("a")).where("a < b")
    note = "; ".join(f"{k}: {v}" for k, v in merge.get("how", {}).items()) or "first value kept"
    return sizes.select(F.lit(table).alias("table"), F.lit(STEPS["merge"]).alias("step"),
                        F.lit(", ".join(merge["key"])).alias("column"), (F.col("b") - F.col("a")).alias("cells_changed"),
                        F.concat(F.col("b").cast("string"), F.lit(" rows")).alias("example_before"),
                        F.concat(F.col("a").cast("string"), F.lit(" rows")).alias("example_after"),
                        F.lit(note).alias("note"))


def cleaning_summary(raw: DataFrame, cleaned: Cleaned) -> DataFrame:
    """One row: cells changed, data problems, rows before and after."""
    zero, one = F.lit(0).cast("bigint"), F.count(F.lit(1))
    parts = [cleaned.log.agg(F.coalesce(F.sum("cells_changed"), zero), zero, zero, zero),
             cleaned.problems.agg(zero, one, zero, zero), raw.agg(zero, zero, one, zero),
             cleaned.data.agg(zero, zero, zero, one)]
    names = ["cells_changed", "data_problems", "rows_before", "rows_after"]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionAll(p)
    return merged.toDF(*names).agg(*[F.sum(n).alias(n) for n in names])
