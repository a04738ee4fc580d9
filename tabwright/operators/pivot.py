"""Pivot tables with totals computed from the rows, not from the cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.numbers import exact_sum, plain_number
from ..functions.text import col, is_number, typed, value_text
from .quantile import quantiles
from .stable import stable

_NUMERIC = ("sum", "mean", "median")


def aggregate(c: Column, calc: str) -> Column:
    """One of the calculations; a sum of nothing is 0. (The median is in `quantiles`.)"""
    made = {"sum": lambda: F.coalesce(exact_sum(c), F.lit(0.0)), "mean": lambda: F.avg(c), "count": lambda: F.count(c),
            "nunique": lambda: F.count_distinct(c), "min": lambda: F.min(c), "max": lambda: F.max(c)}
    if calc not in made:
        raise ValueError(f"calc must be one of {C.CALCS}, not {calc!r}")
    return made[calc]()


def label(df: DataFrame, name: str) -> Column:
    """Group label: the value as text, ``(blank)`` for a missing one."""
    return F.coalesce(value_text(*typed(df, name)), F.lit(C.BLANK))


def grouped(df: DataFrame, labels: Sequence[str], sets: Sequence[Sequence[str]], values: Sequence[str],
            calc: str) -> DataFrame:
    """Aggregate several grouping sets at once: the labels, ``_level`` (which labels are totalled, as
    Spark's grouping id) and one column per value.

    Sets, sums and distinct counts combine on the map side; medians use ranked counts, so a grand total
    never gathers all rows in one task.
    """
    names = [f"_l{i}" for i in range(len(labels))]
    cells = [f"_v{i}" for i in range(len(values))]
    index = {x: n for x, n in zip(labels, names)}
    picked = df.select(*[col(x).alias(n) for x, n in zip(labels, names)],
                       *[(col(v) if v is not None else F.lit(1)).alias(c) for v, c in zip(values, cells)])
    level = F.grouping_id().alias("_level")
    if calc != "median":
        out = picked.groupingSets([[F.col(index[x]) for x in s] for s in sets], *[F.col(n) for n in names]).agg(
            level, *[aggregate(F.col(c), calc).alias(c) for c in cells])
    else:
        # one copy of a row per grouping set, with the totalled labels blanked, then exact ranks per value
        copies = [F.struct(*[(F.col(n) if x in s else F.lit(None).cast("string")).alias(n)
                             for x, n in zip(labels, names)],
                           F.lit(sum(1 << (len(labels) - 1 - i) for i, x in enumerate(labels) if x not in s))
                           .cast("bigint").alias("_level")) for s in sets]
        spread = picked.select(F.inline(F.array(*copies)), *cells)
        out = spread.groupBy(*names, "_level").agg(F.count(F.lit(1)).alias("_rows"))
        for c in cells:
            m = quantiles(spread, [*names, "_level"], c, [0.5])
            m = m.select(*[F.col(n).alias(f"{n}_") for n in [*names, "_level"]], F.col("quantiles")[0].alias(c))
            same = [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in [*names, "_level"]]
            out = out.join(m, same, "left").drop(*[f"{n}_" for n in [*names, "_level"]])
    return out.select(*[F.col(n).alias(x) for n, x in zip(names, labels)], "_level",
                      *[F.col(c).alias(v if v is not None else "Row count") for v, c in zip(values, cells)])


def pivot_table(df: DataFrame, rows: Sequence[str] = (), columns: Sequence[str] = (), values: Sequence[str] = (),
                calc: str = "sum", totals: bool = True, fill_zero: bool = True) -> DataFrame:
    """A pivot table. Without values it counts rows ("Row count"). Without row fields the table is built
    by column and turned on its side, one row per value.

    Totals are computed from the rows per value column, with a "Total" row and column. Row labels, then
    one column per column label ("value | label" when there are several values).
    """
    rows, columns, values = list(rows), list(columns), list(values)
    if not rows and not columns:
        raise ValueError("choose at least one row or column field")
    if calc not in C.CALCS:
        raise ValueError(f"calc must be one of {C.CALCS}, not {calc!r}")
    fields = rows + columns
    counted = not values
    if counted:
        data = df.select(*[label(df, f).alias(f) for f in fields], F.lit(1.0).alias("_Row count"))
        values, calc = ["Row count"], "count"
    else:
        cells = [(plain_number(*typed(df, v)) if calc in _NUMERIC else typed(df, v)[0]).alias(f"_{v}") for v in values]
        data = df.select(*[label(df, f).alias(f) for f in fields], *cells)
    inner = [f"_{v}" for v in values]
    sets = [fields] + ([rows, columns, []] if totals and rows and columns else [[]] if totals else [])
    long = grouped(data, fields, sets, inner, calc)
    long = long.na.drop("all", subset=inner)

    bit = {f: 1 << (len(fields) - 1 - i) for i, f in enumerate(fields)}

    def shown(group: list[str]) -> list[Column]:
        """Labels of a totalled group read Total, '' , '' ..."""
        total = F.col("_level").bitwiseAND(bit[group[0]]) > 0
        return [F.when(total, F.lit(C.TOTAL if i == 0 else "")).otherwise(col(f)) for i, f in enumerate(group)]

    def sort_keys(group: list[str]) -> list[Column]:
        return [(F.col("_level").bitwiseAND(bit[group[0]]) > 0).cast("int"), *[col(f) for f in group]]

    if not columns:
        out = long.orderBy(*sort_keys(rows)).select(
            *[s.alias(f) for s, f in zip(shown(rows), rows)], *[col(i).alias(v) for i, v in zip(inner, values)])
        return _fill(out, values) if fill_zero else out

    long = stable(long)
    joined = F.concat_ws(" | ", F.filter(F.array(*shown(columns)), lambda x: x != ""))
    # a column stands for a combination of labels, or for the total: texts that read alike stay apart
    total = F.col("_level").bitwiseAND(bit[columns[0]]) > 0
    head = F.when(total, F.lit("total")).otherwise(F.to_json(F.array(*[col(c) for c in columns])))
    heads = long.select(head.alias("head"), joined.alias("h"), *[k.alias(f"k{i}") for i, k in enumerate(sort_keys(columns))]).distinct()
    # the result has one column per head, so their number is bounded by the width of a table
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000"))
    found = heads.orderBy(*[f"k{i}" for i in range(len(columns) + 1)]).limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a pivot can have at most {limit} columns; {columns} has more values")
    keys, texts = [r["head"] for r in found], _distinct([r["h"] for r in found], rows or ["Value"])

    if not rows:
        entries = [F.struct(F.lit(i).alias("_i"), F.lit(v).alias("Value"), col(x).alias("_x"))
                   for i, (v, x) in enumerate(zip(values, inner))]
        tall = long.select(head.alias("_head"), F.inline(F.array(*entries)))
        out = tall.groupBy("_i", "Value").pivot("_head", keys).agg(F.first("_x")).orderBy("_i").drop("_i").toDF("Value", *texts)
        return _fill(out, texts) if fill_zero else out

    wide = (long.withColumn("_head", head).groupBy(*[col(r) for r in rows],
                                                   (F.col("_level").bitwiseAND(bit[rows[0]]) > 0).alias("_all"))
            .pivot("_head", keys).agg(F.struct(*[F.first(col(x)).alias(x) for x in inner])))
    single = len(values) == 1
    names = _distinct([t if single else f"{v} | {t}" for v in values for t in texts], rows)
    picks = [col(k)[x].alias(n) for n, (x, k) in zip(names, [(x, k) for x in inner for k in keys])]
    labels = [F.when(F.col("_all"), F.lit(C.TOTAL if i == 0 else "")).otherwise(col(r)).alias(r)
              for i, r in enumerate(rows)]
    out = wide.orderBy("_all", *[col(r) for r in rows]).select(*labels, *picks)
    return _fill(out, names) if fill_zero else out


def _distinct(names: Sequence[str], taken: Sequence[str]) -> list[str]:
    """Column names with a number behind those that another column has already."""
    out: list[str] = []
    for n in names:
        made, i = n, 2
        while made.lower() in {x.lower() for x in (*taken, *out)}:
            made, i = f"{n} ({i})", i + 1
        out.append(made)
    return out


def _fill(df: DataFrame, names: Sequence[str]) -> DataFrame:
    numeric = {f.name for f in df.schema if is_number(f.dataType)}
    return df.select(*[F.coalesce(col(c), F.lit(0).cast(df.schema[c].dataType)).alias(c)
                       if c in names and c in numeric else col(c) for c in df.columns])
