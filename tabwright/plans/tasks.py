"""The seven everyday tasks as one call each: named result frames, ready to be written."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.clean import clean_table, cleaning_summary, restricted, settings
from ..operators.compare import (column_compare_summary, compare_columns, compare_rows, exact_compare, key_warning,
                                 row_compare_summary, rowwise_compare, value_overlap)
from ..operators.fuzzy import fuzzy_compare
from ..operators.pivot import pivot_table
from ..operators.quality import check_quality
from ..operators.rows import data_columns, ensure_rows, find_row

Results = dict[str, DataFrame]


def _lines(row: DataFrame) -> DataFrame:
    """A one-row frame as (item, value) rows."""
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(f"`{c}`").cast("string").alias("value"))
                                         for c in row.columns])))


def _own_settings(tables: Mapping[str, DataFrame], cleaning: Mapping | None) -> dict[str, dict]:
    """The settings of each table: checked against the columns of all, then those that concern it."""
    known = list(dict.fromkeys(c for t in tables.values() for c in data_columns(t)))
    settings(cleaning, known)
    return {k: restricted(cleaning, data_columns(t)) for k, t in tables.items()}


def _clean_all(tables: Mapping[str, DataFrame], cleaning: Mapping | None, as_of) -> tuple[dict, DataFrame, DataFrame, dict]:
    own = _own_settings(tables, cleaning)
    done = {k: clean_table(t, own[k], k, as_of) for k, t in tables.items()}
    log = reduce(DataFrame.unionAll, [c.log for c in done.values()])
    problems = reduce(DataFrame.unionAll, [c.problems for c in done.values()])
    return {k: c.data for k, c in done.items()}, log, problems, done


def check_data(tables: Mapping[str, DataFrame], cleaning: Mapping | None = None, apply_cleaning: bool = True,
               as_of=None, **options) -> Results:
    """Quality of every table, and what would be left after cleaning."""
    tables = {k: ensure_rows(t) for k, t in tables.items()}
    own = _own_settings(tables, cleaning)
    checks = {k: check_quality(t, k, own[k], as_of, **options) for k, t in tables.items()}
    out = {name: reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [getattr(q, part) for q in checks.values()])
           for name, part in (("Overview", "overview"), ("Issues", "issues"), ("Columns", "columns"),
                              ("Similar spellings", "similar"), ("Duplicate rows", "duplicates"))}
    counts = out["Issues"].agg(F.count_if(F.col("level") == "Fix").alias("Problems to fix"),
                               F.count_if(F.col("level") == "Check").alias("Things to check"))
    similar = out["Similar spellings"].agg(F.count(F.lit(1)).alias("Possible typos (similar spellings)"))
    summary = _lines(counts).unionAll(_lines(similar))
    if apply_cleaning:
        data, log, problems, _ = _clean_all(tables, cleaning, as_of)
        after = [check_quality(t, k, own[k], as_of, **options).issues for k, t in data.items()]
        out["Issues after cleaning"] = reduce(DataFrame.unionByName, after)
        out["Cleaning log"], out["Data problems"] = log, problems
        left = out["Issues after cleaning"].agg(
            F.count_if(F.col("level") == "Fix").alias("Fix-level problems left after cleaning"))
        changes = log.agg(F.coalesce(F.sum("cells_changed"), F.lit(0)).alias("Cells cleaning would change"))
        listed = problems.agg(F.count(F.lit(1)).alias("Data problems (rules / unreadable values)"))
        summary = summary.unionAll(_lines(changes)).unionAll(_lines(left)).unionAll(_lines(listed))
    return {"Summary": summary, **out}


def clean_data(tables: Mapping[str, DataFrame], cleaning: Mapping | None = None, as_of=None) -> Results:
    tables = {k: ensure_rows(t) for k, t in tables.items()}
    data, log, problems, done = _clean_all(tables, cleaning, as_of)
    summary = reduce(DataFrame.unionAll, [
        _lines(cleaning_summary(tables[k], c)).select(F.concat(F.lit(f"Table {k}: "), "item").alias("item"), "value")
        for k, c in done.items()])
    return {"Summary": summary, "Cleaning log": log, "Data problems": problems,
            **{f"Cleaned {k}": t for k, t in data.items()}}


def run_task(task: str, a: DataFrame, b: DataFrame | None = None, options: Mapping | None = None,
             cleaning: Mapping | None = None, apply_cleaning: bool = True, as_of=None) -> Results:
    """One of check_data, clean_data, pivot, compare_tables, fuzzy_compare, compare_columns, compare_rows.

    ``options`` are the arguments of the matching operator. Tables are cleaned first unless told otherwise.
    """
    o = dict(options or {})
    tables = {"A": ensure_rows(a), **({"B": ensure_rows(b)} if b is not None else {})}
    if task == "check_data":
        return check_data(tables, cleaning, apply_cleaning, as_of, **o)
    if task == "clean_data":
        return clean_data(tables, cleaning, as_of)
    makers = {"pivot": _pivot, "compare_tables": _compare, "fuzzy_compare": _fuzzy, "compare_columns": _columns,
              "compare_rows": _rows}
    if task not in makers:
        raise ValueError(f"task must be one of {['check_data', 'clean_data', *makers]}, not {task!r}")
    extra: Results = {}
    if apply_cleaning:
        known = {c for t in tables.values() for c in t.columns}
        rules = [r for r in (cleaning or {}).get("rules", []) if {r["column"], r.get("not_after", r["column"])} <= known]
        tables, log, problems, _ = _clean_all(tables, {**(cleaning or {}), "rules": rules}, as_of)
        extra = {"Cleaning log": log, "Data problems": problems}
    return {**makers[task](tables, o), **extra}


def _pivot(tables: Mapping[str, DataFrame], o: Mapping) -> Results:
    made = pivot_table(tables["A"], **o)
    return {"Summary": _lines(made.agg(F.count(F.lit(1)).alias("Result rows"))), "Pivot": made}


def _compare(tables: Mapping[str, DataFrame], o: Mapping) -> Results:
    r = exact_compare(tables["A"], tables["B"], **o)
    warning = key_warning(r.stats).select(F.lit("WARNING").alias("item"), F.col("warning").alias("value"))
    return {"Summary": _lines(r.stats).unionAll(warning), "Different values": r.diffs, "Only in A": r.only_a,
            "Only in B": r.only_b}


def _fuzzy(tables: Mapping[str, DataFrame], o: Mapping) -> Results:
    r = fuzzy_compare(tables["A"], tables["B"], **o)
    return {"Summary": _lines(r.stats), "Matches": r.matches, "Different values": r.diffs, "Only in A": r.only_a,
            "Only in B": r.only_b}


def _columns(tables: Mapping[str, DataFrame], o: Mapping) -> Results:
    a, b = tables["A"], tables["B"]
    x, y, case = o["column_a"], o["column_b"], o.get("ignore_case", False)
    overlap = value_overlap(a, x, b, y, case)
    rows = rowwise_compare(a, x, b, y, o.get("tolerance", 0.0), case)
    summary = column_compare_summary(overlap, rows).select("item", F.col("value").cast("string").alias("value"))
    return {"Summary": summary, "Column stats": compare_columns(a, x, b, y), "Values in both": overlap.both,
            "Values only in A": overlap.only_a, "Values only in B": overlap.only_b, "Row by row": rows}


def _rows(tables: Mapping[str, DataFrame], o: Mapping) -> Results:
    made = compare_rows(tables["A"], o["by_a"], o["value_a"], tables["B"], o["by_b"], o["value_b"], o.get("pairs"),
                        o.get("ignore_case", True), o.get("tolerance", 0.0))
    notes = [find_row(tables[t], o[f"by_{s}"], o[f"value_{s}"]).where("hits > 1").select(
        F.lit("Note").alias("item"), F.format_string("%d rows matched; using the first.", "hits").alias("value"))
        for t, s in (("A", "a"), ("B", "b"))]
    summary = reduce(DataFrame.unionAll, notes, _lines(row_compare_summary(made)))
    return {"Summary": summary, "Row comparison": made}
