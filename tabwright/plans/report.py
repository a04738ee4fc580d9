"""A periodic report: trend over time, top categories, a pivot and formula checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.dates import parse_date, period_label, period_last_day, period_start, period_step
from ..functions.numbers import exact_sum, parse_number
from ..functions.text import col, typed, value_text
from ..operators.clean import clean_table, cleaning_summary
from ..operators.pivot import aggregate, label, pivot_table
from ..operators.quantile import quantiles
from ..operators.rows import ensure_rows
from ..operators.rules import check_formulas
from ..operators.stable import stable

ADDITIVE = ("sum", "count", "nunique")

# The default settings of a report.
DEFAULTS = {
    "date_column": None, "period": "month", "value_columns": [], "calc": "sum", "category_column": None, "top_n": 10,
    "pivot_rows": [], "pivot_columns": [], "pivot_values": [], "pivot_calc": "sum", "pivot_totals": True,
    "formula_checks": [], "show_columns": [], "use_cleaning": True, "cleaning": {}, "include_data": False,
    "day_first": True, "decimal": ".",
}


def settings(spec: Mapping, columns: Sequence[str]) -> dict:
    s = {**DEFAULTS, **spec}
    unknown = set(spec) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown report settings {sorted(unknown)}; known: {sorted(DEFAULTS)}")
    named = [*s["value_columns"], *s["show_columns"], *([s["date_column"]] if s["date_column"] else []),
             *([s["category_column"]] if s["category_column"] else [])]
    missing = [c for c in named if c not in columns]
    if missing:
        raise ValueError(f"no such columns: {missing}; columns: {list(columns)}")
    if s["period"] not in C.PERIODS:
        raise ValueError(f"period must be one of {list(C.PERIODS)}")
    if s["calc"] not in C.CALCS or s["pivot_calc"] not in C.CALCS:
        raise ValueError(f"calc and pivot_calc must be among {C.CALCS}")
    if not isinstance(s["top_n"], int) or s["top_n"] < 1:
        raise ValueError("top_n is a whole number, 1 or more")
    for check in s["formula_checks"]:
        if not {"check", "equals"} <= set(check) <= {"name", "check", "equals", "tolerance", "tolerance_pct"}:
            raise ValueError("a formula check has check and equals, and may have name, tolerance, tolerance_pct")
    return s


def add_period(df: DataFrame, date_column: str, period: str, day_first: bool = True) -> tuple[DataFrame, str]:
    """The frame with its period label column, and that column's name."""
    word = C.PERIODS[period]
    name = word if word not in df.columns else f"{date_column} ({word.lower()})"
    moment = parse_date(*typed(df, date_column), day_first)
    return df.withColumn(name, period_label(moment, period)), name


def _calculated(df: DataFrame, keys: Sequence[str], values: Sequence[str], calc: str) -> DataFrame:
    """Group by keys: one column per value, plus ``rows``."""
    rows = F.count(F.lit(1)).alias("_rows")
    keyed = [col(k) for k in keys]
    if calc != "median":
        return df.groupBy(*keyed).agg(*[aggregate(col(v), calc).alias(v) for v in values], rows)
    out = df.groupBy(*keyed).agg(rows)
    for v in values:
        m = quantiles(df, keys, v, [0.5]).select(*[col(k).alias(f"_{k}") for k in keys], F.col("quantiles")[0].alias(v))
        out = out.join(m, [col(k).eqNullSafe(col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])
    return out.select(*keyed, *[col(v) for v in values], "_rows")


def _calendar(periods: DataFrame, period: str) -> DataFrame:
    """Every period between the first and the last of a small table of periods."""
    span = periods.agg(F.min("_p").alias("a"), F.max("_p").alias("b")).where("a is not null")
    step = F.expr(f"interval {period_step(period)}")
    return span.select(F.explode(F.sequence("a", "b", step)).alias("_p"))


def _numbers(df: DataFrame, columns: Sequence[str], decimal: str) -> list[Column]:
    return [parse_number(*typed(df, v), decimal).alias(v) for v in columns]


def trend(df: DataFrame, date_column: str, period: str, values: Sequence[str] = (), calc: str = "sum",
          day_first: bool = True, decimal: str = ".") -> DataFrame:
    """One row per period from the first to the last, gaps included: label, calculated values, rows and
    the change of the first value (or of the rows) against the period before, in percent.

    The rows are aggregated to one line per period before anything else; gap filling and the look back
    are joins of that small table on the period.
    """
    p = period_start(parse_date(*typed(df, date_column), day_first), period).alias("_p")
    dated = df.select(p, *_numbers(df, values, decimal)).where("_p is not null")
    grouped = stable(_calculated(dated, ["_p"], values, calc))       # one line per period: the rows are read once
    full = _calendar(grouped, period).join(grouped, "_p", "left")
    zero = [F.coalesce(col(v).cast("double"), F.lit(0.0)) if calc in ADDITIVE else col(v) for v in values]
    full = full.select("_p", *[z.alias(v) for z, v in zip(zero, values)],
                       F.coalesce("_rows", F.lit(0).cast("bigint")).alias("_rows"))
    metric = values[0] if values else "_rows"
    before = full.select((F.col("_p") + F.expr(f"interval {period_step(period)}")).cast("date").alias("_p"),
                         col(metric).cast("double").alias("_before"))
    change = F.bround(F.try_divide(col(metric) - F.col("_before"), F.col("_before")) * 100, 1)
    return full.join(before, "_p", "left").orderBy("_p").select(
        period_label(F.col("_p"), period).alias(C.PERIODS[period]), *[col(v).alias(f"{v} ({calc})") for v in values],
        F.col("_rows").alias("Rows"), change.alias("Change vs previous %"))


# calculations of a whole that follow from those of its parts, and how
FROM_PARTS = {"sum": "sum", "count": "sum", "min": "min", "max": "max"}


def _combined(parts: DataFrame, keys: Sequence[str], values: Sequence[str], calc: str) -> DataFrame:
    """Coarser groups from finer ones that `_calculated` made."""
    made = {"sum": F.sum, "min": F.min, "max": F.max}[FROM_PARTS[calc]]
    return parts.groupBy(*[col(k) for k in keys]).agg(*[made(col(v)).alias(v) for v in values],
                                                     F.sum("_rows").alias("_rows"))


def top_categories(ranked: DataFrame, metric: str | None, top_n: int) -> DataFrame:
    """(category, place) of the highest ranked categories out of one line per category; ties go to the
    smaller name. At most ``top_n`` rows, written once."""
    order = F.col(metric).desc_nulls_last() if metric else F.desc("_rows")
    best = ranked.orderBy(order, "_c").limit(top_n)
    return stable(best.select("_c", F.row_number().over(W.orderBy(order, "_c")).alias("_place")))


def _mapped(data: DataFrame, top: DataFrame) -> DataFrame:
    """Rows with their category, the ones outside the top as "Other"."""
    return data.join(F.broadcast(top), "_c", "left").select(
        F.when(F.col("_place").isNotNull(), F.col("_c")).otherwise(C.OTHER).alias("_c"),
        *[c for c in data.columns if c != "_c"])


def category_breakdown(df: DataFrame, category: str, values: Sequence[str] = (), calc: str = "sum", top_n: int = 10,
                       decimal: str = ".") -> DataFrame:
    """The top categories and "Other", calculated from the rows, with their share of the total in percent.

    Sums, counts and extremes of "Other" follow from one line per category, so the rows are read once;
    averages, medians and distinct counts go back to the rows.
    """
    data = df.select(label(df, category).alias("_c"), *_numbers(df, values, decimal))
    metric = values[0] if values else None
    additive = not values or calc in FROM_PARTS
    ranked = _calculated(data, ["_c"], values if additive else [metric], calc)
    ranked = stable(ranked) if additive else ranked
    top = top_categories(ranked, metric, top_n)
    table = (_combined(_mapped(ranked, top), ["_c"], values, calc if values else "sum") if additive
             else _calculated(_mapped(data, top), ["_c"], values, calc))
    shared = metric if metric and calc in ("sum", "count") else "_rows"
    share = F.bround(F.try_divide(col(shared), F.sum(col(shared)).over(W.partitionBy())) * 100, 1)
    title = f"Share % (of {metric})" if shared == metric else "Share % (of rows)"
    placed = table.join(F.broadcast(top), "_c", "left").withColumn("_share", share)
    return placed.orderBy(F.col("_place").asc_nulls_last()).select(
        F.col("_c").alias(category), *[col(v).alias(f"{v} ({calc})") for v in values], F.col("_rows").alias("Rows"),
        F.col("_share").alias(title))


def trend_by_category(df: DataFrame, date_column: str, period: str, category: str, metric: str | None = None,
                      calc: str = "sum", top_n: int = 10, day_first: bool = True, decimal: str = ".") -> DataFrame:
    """One row per period, gaps included, and one column per top category (and "Other")."""
    p = period_start(parse_date(*typed(df, date_column), day_first), period).alias("_p")
    values = [metric] if metric else []
    data = df.select(p, label(df, category).alias("_c"), *_numbers(df, values, decimal))
    if not metric or calc in FROM_PARTS:
        parts = stable(_calculated(data, ["_p", "_c"], values, calc))    # the rows are read once
        way = calc if metric else "sum"
        top = top_categories(_combined(parts, ["_c"], values, way), metric, top_n)
        small = _combined(_mapped(parts.where("_p is not null"), top), ["_p", "_c"], values, way)
    else:
        top = top_categories(_calculated(data, ["_c"], values, calc), metric, top_n)
        small = _calculated(_mapped(data.where("_p is not null"), top), ["_p", "_c"], values, calc)
    small = stable(small)
    heads = [r["_c"] for r in top.orderBy("_place").collect()]        # at most top_n
    other = C.OTHER in heads or small.where(F.col("_c") == C.OTHER).limit(1).count() == 0
    columns = heads + ([] if other else [C.OTHER])
    wide = small.groupBy("_p").pivot("_c", columns).agg(F.first(col(metric) if metric else F.col("_rows")))
    full = _calendar(small, period).join(wide, "_p", "left").orderBy("_p")
    fill = calc in ADDITIVE or not metric
    return full.select(period_label(F.col("_p"), period).alias(C.PERIODS[period]), *[
        (F.coalesce(col(h).cast("double"), F.lit(0.0)) if fill else col(h)).alias(h) for h in columns])


def measure_totals(df: DataFrame, values: Sequence[str], decimal: str = ".") -> DataFrame:
    """Total, average, smallest and largest of every value column: one pass, one row per column."""
    data = df.select(*_numbers(df, values, decimal))
    entries = []
    for v in values:
        c = col(v)
        entries.append(F.struct(F.lit(v).alias("column"), F.bround(F.coalesce(exact_sum(c), F.lit(0.0)), 2).alias("total"),
                                F.bround(F.avg(c), 2).alias("average"), F.min(c).alias("smallest"),
                                F.max(c).alias("largest")))
    return data.agg(F.array(*entries).alias("m")).select(F.inline("m"))


def period_facts(df: DataFrame, date_column: str, period: str, day_first: bool = True) -> DataFrame:
    """One row: first and last day, label of the latest period, whether it is complete, undated rows."""
    moment = parse_date(*typed(df, date_column), day_first)
    span = df.select(moment.cast("date").alias("d")).agg(
        F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count_if(F.col("d").isNull()).alias("undated_rows"))
    end = period_last_day(period_start(F.col("last_day"), period), period)
    return span.select("first_day", "last_day", period_label(F.col("last_day"), period).alias("latest_period"),
                       (F.col("last_day") >= end).alias("latest_complete"), "undated_rows")


def report(df: DataFrame, spec: Mapping, as_of=None) -> dict[str, DataFrame]:
    """All parts of a report by name. The cleaned rows are written once for all parts."""
    s = settings(spec, df.columns)
    df = ensure_rows(df)
    out: dict[str, DataFrame] = {}
    lines: list[DataFrame] = []

    def line(source: DataFrame, *items: tuple[str, Column]) -> None:
        made = [F.struct(F.lit(k).alias("item"), v.cast("string").alias("value")) for k, v in items]
        lines.append(source.select(F.inline(F.array(*made))).where("value is not null"))

    if s["use_cleaning"]:
        cleaned = clean_table(df, {"day_first": s["day_first"], "decimal": s["decimal"], **s["cleaning"]}, as_of=as_of)
        line(cleaning_summary(df, cleaned), ("Cleaning", F.format_string(
            "%d cells changed, %d duplicate rows removed, %d data problems", F.col("cells_changed"),
            F.col("rows_before") - F.col("rows_after"), F.col("data_problems"))))
        extra = {"Cleaning log": cleaned.log.drop("table"), "Data problems": cleaned.problems.drop("table")}
        df = cleaned.data
    else:
        extra = {}
    date, period, calc, values = s["date_column"], s["period"], s["calc"], list(s["value_columns"])
    period_column = None
    if date:
        df, period_column = add_period(df, date, period, s["day_first"])
    df = stable(df)
    line(df.agg(F.count(F.lit(1)).alias("n")), ("Rows in report", F.col("n")))
    if values:      # every value column in one pass
        kinds = ("total", "average", "smallest", "largest")
        shown = F.array(*[F.struct(F.concat("column", F.lit(f" - {c}")).alias("item"), value_text(F.col(c), T.DoubleType()).alias("value"))
                          for c in kinds])
        lines.append(measure_totals(df, values, s["decimal"]).select(F.inline(shown)).where("value is not null"))
    metric = values[0] if values else None
    metric_name = f"{metric} ({calc})" if metric else "Rows"
    if date:
        out["Trend"] = trend(df, date, period, values, calc, s["day_first"], s["decimal"])
        facts = period_facts(df, date, period, s["day_first"])
        note = F.when(~F.col("latest_complete"), F.format_string(
            f"The latest {period} is not complete - data runs until %s", F.col("last_day").cast("string")))
        line(facts, ("From", F.col("first_day")), ("To", F.col("last_day")), (f"Latest {period}", F.col("latest_period")),
             ("Note", note), ("Rows without a valid date (not in the trend)",
                              F.when(F.col("undated_rows") > 0, F.col("undated_rows"))))
        latest = out["Trend"].join(facts.select(F.col("latest_period").alias(C.PERIODS[period])), C.PERIODS[period])
        line(latest, (f"{metric_name} in latest {period}", value_text(F.bround(col(metric_name).cast("double"), 2), T.DoubleType())),
             (f"Change vs previous {period}", F.concat(F.col("Change vs previous %").cast("string"), F.lit("%"))))
    category = s["category_column"]
    if category:
        table = category_breakdown(df, category, values, calc, s["top_n"], s["decimal"])
        out[f"By {category}"] = table
        line(df.agg(F.count_distinct(label(df, category)).alias("n")), (f"{category} - distinct values", F.col("n")))
        share = table.columns[-1]
        line(table.limit(1), (f"Largest {category}", F.concat(col(category), F.lit(" ("), col(share).cast("string"), F.lit("%)"))))
        if date:
            out[f"Trend by {category}"] = trend_by_category(df, date, period, category, metric, calc, s["top_n"],
                                                            s["day_first"], s["decimal"])
    rows, columns = list(s["pivot_rows"]), list(s["pivot_columns"])
    if rows or columns:
        words = {"period", *[w.lower() for w in C.PERIODS.values()]}

        def named(c: str) -> str:
            return period_column if period_column and c.lower() in words and c not in df.columns else c

        out["Pivot"] = pivot_table(df, [named(c) for c in rows], [named(c) for c in columns], s["pivot_values"],
                                   s["pivot_calc"], s["pivot_totals"])
    if s["formula_checks"]:
        checked = check_formulas(df, s["formula_checks"], s["show_columns"], s["decimal"])
        out["Formula checks"], out["Formula mismatches"] = checked
        lines.append(checked.summary.select(F.concat(F.lit("Check: "), "check").alias("item"), F.format_string(
            "%d mismatch(es) in %d rows (%d could not be checked)", "mismatches", "rows_checked",
            "could_not_check").alias("value")))
    out.update(extra)
    if s["include_data"]:
        out["Data"] = df
    return {"Summary": reduce(DataFrame.unionAll, lines), **out}
