"""Trends, categories, pivots, totals, row numbers and quantiles."""

from pyspark.sql import functions as F

from tabwright.functions import period_label
from tabwright.operators import pivot_table, quantiles, with_row_number
from tabwright.plans.report import (category_breakdown, measure_totals, period_facts, report, trend, trend_by_category)

from .inputs import read, with_row

# label in SQL for every period length
LABEL = {"day": "strftime({0}, '%Y-%m-%d')", "week": "'Week of ' || strftime(date_trunc('week', {0}), '%Y-%m-%d')",
         "month": "strftime({0}, '%Y-%m')", "quarter": "year({0}) || '-Q' || quarter({0})",
         "year": "CAST(year({0}) AS VARCHAR)"}
STEP = {"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH", "quarter": "3 MONTH", "year": "1 YEAR"}


def _trend(table, date, period, value, calc, digits=2):
    def run(spark, folder):
        t = trend(read(spark, folder, table), date, period, [value] if value else [], calc)
        label, change = t.columns[0], t.columns[-1]
        cells = [F.round(F.col(f"`{value} ({calc})`").cast("double"), digits).alias("metric")] if value else []
        return t.select(F.col(label).alias("period"), *cells, F.col("Rows").alias("n_rows"),
                        F.col(f"`{change}`").alias("change_pct"))

    agg = {"sum": f"coalesce(sum({value}), 0)", "mean": f"avg({value})", "median": f"median({value})",
           "nunique": f"count(DISTINCT {value})"}.get(calc, "") if value else "count(*)"
    fill = "coalesce(g.m, 0)" if not value or calc in ("sum", "nunique") else "g.m"
    sql = f"""
WITH g AS (SELECT CAST(date_trunc('{period}', {date}) AS DATE) AS p, {agg} AS m, count(*) AS n FROM {table} GROUP BY 1),
cal AS (SELECT CAST(unnest(generate_series((SELECT CAST(min(p) AS TIMESTAMP) FROM g),
        (SELECT CAST(max(p) AS TIMESTAMP) FROM g), INTERVAL {STEP[period]})) AS DATE) AS p),
f AS (SELECT cal.p, CAST({fill} AS DOUBLE) AS m, coalesce(g.n, 0) AS n FROM cal LEFT JOIN g USING (p)),
c AS (SELECT p, m, n, lag(m) OVER (ORDER BY p) AS b FROM f)
SELECT {LABEL[period].format('p')} AS period, {f'round(m, {digits}) AS metric,' if value else ''}
       CAST(n AS BIGINT) AS n_rows,
       CASE WHEN b <> 0 THEN round_even((m - b) / b * 100, 1) END AS change_pct FROM c"""
    return run, sql


def _labels():
    def run(spark, folder):
        e = read(spark, folder, "events")
        return e.select("event_id", *[period_label(F.col("ts"), p).alias(f"{p}_label") for p in LABEL])

    return run, "SELECT event_id, " + ", ".join(f"{x.format('ts')} AS {p}_label" for p, x in LABEL.items()) + " FROM events"


def _pivot(rows, columns, values, calc, table, digits, cells, totals=True, fill=True):
    """``cells``: the column labels, known for these tables."""
    def run(spark, folder):
        p = pivot_table(read(spark, folder, table), rows, columns, values, calc, totals, fill)
        number = dict(p.dtypes)
        return p.select(*[F.round(F.col(f"`{c}`"), digits).alias(c.replace(" | ", "_")) if number[c] == "double"
                          else F.col(f"`{c}`").alias(c.replace(" | ", "_")) for c in p.columns])

    names = {"sum": "sum", "mean": "avg", "median": "median", "min": "min", "max": "max"}

    def agg(v, where):
        f = f" FILTER (WHERE {where})" if where else ""
        if v is None:
            return f"count(*){f}"
        if calc in ("count", "nunique"):
            return f"count({'DISTINCT ' if calc == 'nunique' else ''}{v}){f}"
        return f"round({'coalesce(' if fill else ''}CAST({names[calc]}({v}){f} AS DOUBLE){', 0)' if fill else ''}, {digits})"

    r = rows[0] if rows else None
    wanted = values or [None]
    heads = [(h, f"{columns[0]} = '{h}'") for h in cells] + ([("Total", None)] if totals else []) if columns else []
    if rows:
        label = f"CASE WHEN grouping({r}) = 1 THEN 'Total' ELSE CAST({r} AS VARCHAR) END AS {r}"
        if columns:
            picks = [f'{agg(v, w)} AS "{h if len(wanted) == 1 else f"{v}_{h}"}"' for v in wanted for h, w in heads]
        else:
            picks = [f'{agg(v, None)} AS "{v or "Row count"}"' for v in wanted]
        sets = f"GROUPING SETS (({r}), ())" if totals else f"({r})"
        sql = f"SELECT {label}, {', '.join(picks)} FROM {table} GROUP BY {sets}"
    else:
        sql = " UNION ALL ".join(
            f"""SELECT '{v or "Row count"}' AS "Value", """ + ", ".join(f'{agg(v, w)} AS "{h}"' for h, w in heads)
            + f" FROM {table}" for v in wanted)
    return run, sql


STATUS = ["F", "O", "P"]


def _categories(metric, calc, top, digits=2):
    def run(spark, folder):
        t = _lines(spark, folder)
        b = category_breakdown(t, "p_brand", [metric] if metric else [], calc, top)
        cells = [F.round(F.col(f"`{metric} ({calc})`"), digits).alias("metric")] if metric else []
        return b.select(F.col("p_brand").alias("category"), *cells, F.col("Rows").alias("n_rows"),
                        F.col(f"`{b.columns[-1]}`").alias("share_pct"))

    agg = {"sum": f"sum({metric})", "mean": f"avg({metric})", "median": f"median({metric})"}[calc] if metric else "count(*)"
    share = "m" if metric and calc in ("sum", "count") else "n"
    return run, f"""
WITH l AS (SELECT p_brand, l_extendedprice, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey),
r AS (SELECT p_brand, row_number() OVER (ORDER BY {agg} DESC, p_brand) AS k FROM l GROUP BY p_brand),
m AS (SELECT CASE WHEN k <= {top} THEN p_brand ELSE 'Other' END AS c, l.* FROM l JOIN r USING (p_brand)),
g AS (SELECT c, CAST({agg} AS DOUBLE) AS m, count(*) AS n FROM m GROUP BY c)
SELECT c AS category, {f'round(m, {digits}) AS metric,' if metric else ''} n AS n_rows,
       round_even({share} / sum({share}) OVER () * 100, 1) AS share_pct FROM g"""


def _lines(spark, folder):
    li = read(spark, folder, "lineitem").select("l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
    parts = read(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return li.join(parts, "l_partkey")


def _trend_by_category():
    def run(spark, folder):
        t = trend_by_category(read(spark, folder, "orders"), "o_orderdate", "quarter", "o_orderpriority", "o_totalprice",
                              "sum", 3)
        return t.select(F.col("Quarter").alias("period"), *[F.round(F.col(f"`{c}`"), 2).alias(f"c{i}")
                                                            for i, c in enumerate(t.columns[1:])])

    picks = ", ".join(f"coalesce(round(sum(o_totalprice) FILTER (WHERE k = {i + 1}), 2), 0) AS c{i}" for i in range(3))
    return run, f"""
WITH r AS (SELECT o_orderpriority, row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_orderpriority) AS k
           FROM orders GROUP BY 1)
SELECT {LABEL['quarter'].format('o_orderdate')} AS period, {picks},
       coalesce(round(sum(o_totalprice) FILTER (WHERE k > 3), 2), 0) AS c3
FROM orders JOIN r USING (o_orderpriority) GROUP BY 1"""


def _totals():
    def run(spark, folder):
        return measure_totals(read(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice"]).select(
            F.col("column").alias("measure"), F.round("total", 2).alias("total"), F.round("average", 2).alias("average"),
            "smallest", "largest")

    return run, " UNION ALL ".join(f"""SELECT '{c}' AS measure, round(sum({c}), 2) AS total, round_even(avg({c}), 2) AS average,
        min({c}) AS smallest, max({c}) AS largest FROM lineitem""" for c in ("l_quantity", "l_extendedprice"))


def _facts():
    def run(spark, folder):
        return period_facts(read(spark, folder, "orders"), "o_orderdate", "quarter")

    return run, f"""SELECT CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day,
        {LABEL['quarter'].format('max(o_orderdate)')} AS latest_period,
        CAST(max(o_orderdate) AS DATE) >= CAST(date_trunc('quarter', max(o_orderdate)) + INTERVAL 3 MONTH AS DATE) - 1
            AS latest_complete,
        count(*) - count(o_orderdate) AS undated_rows FROM orders"""


def _row_numbers():
    def run(spark, folder):
        e = read(spark, folder, "events").select("event_id", "user_id", "value")
        return with_row_number(e, ["user_id", F.desc("value"), "event_id"])

    return run, """SELECT event_id, user_id, value,
        row_number() OVER (ORDER BY user_id, value DESC, event_id) - 1 AS _row FROM events"""


def _quartiles():
    def run(spark, folder):
        q = quantiles(read(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice",
                      [0.25, 0.5, 0.75])
        return q.select("l_returnflag", "l_linestatus", F.col("count").alias("n"),
                        *[F.round(F.col("quantiles")[i], 4).alias(f"q{i + 1}") for i in range(3)])

    return run, """SELECT l_returnflag, l_linestatus, count(*) AS n, """ + ", ".join(
        f"round(quantile_cont(l_extendedprice, {x}), 4) AS q{i + 1}" for i, x in enumerate((0.25, 0.5, 0.75))) + """
        FROM lineitem GROUP BY 1, 2"""


def _report_summary():
    def run(spark, folder):
        made = report(with_row(read(spark, folder, "orders"), "o_orderkey"), {
            "date_column": "o_orderdate", "period": "quarter", "value_columns": ["o_totalprice"],
            "category_column": "o_orderpriority", "top_n": 3, "use_cleaning": False, "pivot_rows": ["o_orderstatus"],
            "formula_checks": [{"name": "positive", "check": "[o_totalprice]", "equals": "[o_totalprice] / 1"}]})
        return made["Summary"]

    return run, f"""
WITH g AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS p, sum(o_totalprice) AS m FROM orders GROUP BY 1),
c AS (SELECT p, m, lag(m) OVER (ORDER BY p) AS b FROM g), last AS (SELECT * FROM c ORDER BY p DESC LIMIT 1),
o AS (SELECT count(*) AS n, sum(o_totalprice) AS s, round_even(avg(o_totalprice), 2) AS av, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
             CAST(min(o_orderdate) AS DATE) AS d0, CAST(max(o_orderdate) AS DATE) AS d1,
             {LABEL['quarter'].format('max(o_orderdate)')} AS lp, count(DISTINCT o_orderpriority) AS np FROM orders),
k AS (SELECT o_orderpriority AS c, sum(o_totalprice) AS m FROM orders GROUP BY 1),
top AS (SELECT c, round_even(m / (SELECT sum(m) FROM k) * 100, 1) AS sh FROM k ORDER BY m DESC, c LIMIT 1)
SELECT 'Rows in report' AS item, CAST(n AS VARCHAR) AS value FROM o
UNION ALL SELECT 'o_totalprice - total', rtrim(CAST(CAST(s AS DECIMAL(20, 2)) AS VARCHAR), '0') FROM o
UNION ALL SELECT 'o_totalprice - average', CAST(av AS VARCHAR) FROM o
UNION ALL SELECT 'o_totalprice - smallest', CAST(lo AS VARCHAR) FROM o
UNION ALL SELECT 'o_totalprice - largest', CAST(hi AS VARCHAR) FROM o
UNION ALL SELECT 'From', CAST(d0 AS VARCHAR) FROM o UNION ALL SELECT 'To', CAST(d1 AS VARCHAR) FROM o
UNION ALL SELECT 'Latest quarter', lp FROM o
UNION ALL SELECT 'Note', 'The latest quarter is not complete - data runs until ' || d1 FROM o
UNION ALL SELECT 'o_totalprice (sum) in latest quarter', rtrim(CAST(CAST(m AS DECIMAL(20, 2)) AS VARCHAR), '0') FROM last
UNION ALL SELECT 'Change vs previous quarter', CAST(round_even((m - b) / b * 100, 1) AS VARCHAR) || '%' FROM last
UNION ALL SELECT 'o_orderpriority - distinct values', CAST(np AS VARCHAR) FROM o
UNION ALL SELECT 'Largest o_orderpriority', c || ' (' || CAST(sh AS VARCHAR) || '%)' FROM top
UNION ALL SELECT 'Check: positive', '0 mismatch(es) in ' || n || ' rows (0 could not be checked)' FROM o"""


QUERIES = {
    "trend_month": _trend("orders", "o_orderdate", "month", "o_totalprice", "sum"),
    "trend_week_rows": _trend("lineitem", "l_shipdate", "week", None, "sum"),
    "trend_day_mean": _trend("events", "ts", "day", "value", "mean", 4),
    "trend_quarter_nunique": _trend("orders", "o_orderdate", "quarter", "o_custkey", "nunique"),
    "trend_year_median": _trend("lineitem", "l_shipdate", "year", "l_extendedprice", "median", 4),
    "period_labels": _labels(),
    "period_facts": _facts(),
    "category_topn_sum": _categories("l_extendedprice", "sum", 5),
    "category_topn_mean": _categories("l_extendedprice", "mean", 7, 4),
    "category_topn_median": _categories("l_quantity", "median", 5, 4),
    "category_topn_rows": _categories(None, "count", 8),
    "trend_by_category": _trend_by_category(),
    "measure_totals": _totals(),
    "report_summary": _report_summary(),
    "pivot_sum": _pivot(["o_orderpriority"], ["o_orderstatus"], ["o_totalprice"], "sum", "orders", 2, STATUS),
    "pivot_mean": _pivot(["o_orderpriority"], ["o_orderstatus"], ["o_totalprice"], "mean", "orders", 4, STATUS),
    "pivot_median": _pivot(["o_orderpriority"], ["o_orderstatus"], ["o_totalprice"], "median", "orders", 4, STATUS),
    "pivot_nunique": _pivot(["o_orderpriority"], ["o_orderstatus"], ["o_custkey"], "nunique", "orders", 2, STATUS),
    "pivot_count": _pivot(["o_orderpriority"], ["o_orderstatus"], ["o_custkey"], "count", "orders", 2, STATUS),
    "pivot_row_count": _pivot(["l_returnflag"], ["l_linestatus"], [], "sum", "lineitem", 2, ["F", "O"]),
    "pivot_two_values_max": _pivot(["l_returnflag"], ["l_linestatus"], ["l_quantity", "l_extendedprice"], "max",
                                   "lineitem", 2, ["F", "O"]),
    "pivot_min_no_totals": _pivot(["l_returnflag"], ["l_linestatus"], ["l_tax"], "min", "lineitem", 2, ["F", "O"], False,
                                  False),
    "pivot_columns_only": _pivot([], ["l_returnflag"], ["l_quantity", "l_extendedprice"], "sum", "lineitem", 2,
                                 ["A", "N", "R"]),
    "pivot_rows_only": _pivot(["c_nationkey"], [], ["c_acctbal"], "mean", "customer", 4, []),
    "row_numbers": _row_numbers(),
    "quantiles_by_group": _quartiles(),
}
