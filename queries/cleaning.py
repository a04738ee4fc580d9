"""Cleaning, rules, duplicates and quality checks."""

from pyspark.sql import functions as F

from tabwright.operators import (check_formulas, check_quality, clean_table, cleaning_summary, drop_duplicate_rows,
                                 duplicate_rows, evaluate_rules, merge_rows, unify_spelling)
from tabwright.operators.quality import exact_and_hidden_duplicates
from tabwright.plans.tasks import run_task

from .comparing import LCS
from .inputs import customer_dirty, customer_restated, orders_dirty, read, with_row

DAY = "2000-06-30"


def _rule(table, key, rule, where, problem, value, as_of=DAY):
    """One rule over one table whose row number is its key."""
    def run(spark, folder):
        return evaluate_rules(with_row(read(spark, folder, table), key), [rule], as_of=as_of)

    return run, f"""SELECT 'A' AS "table", {key} + 2 AS row_in_file, '{rule["column"]}' AS "column", {value} AS value,
        '{problem}' AS problem FROM {table} WHERE {where}"""


def _required(spark, folder):
    return evaluate_rules(customer_restated(spark, folder), [{"column": "ref", "required": True}])


def _not_after(spark, folder):
    o = with_row(read(spark, folder, "orders"), "o_orderkey")
    first = read(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_shipdate").alias("first_ship"))
    return evaluate_rules(o.join(first, "o_orderkey"), [{"column": "first_ship", "not_after": "o_orderdate"}])


def _unread_rules(spark, folder):
    """Rules on columns still held as text: numbers and dates are read on the way."""
    return evaluate_rules(orders_dirty(spark, folder), [{"column": "price_text", "min": 0, "max": 400000},
                                                       {"column": "date_text", "not_future": True}], as_of=DAY)


def _checks(spark, folder):
    li = read(spark, folder, "lineitem")
    p = read(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = li.join(p, "l_partkey").withColumn("_row", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return check_formulas(rows, [
        {"name": "price", "check": "[l_extendedprice]", "equals": "[l_quantity] * [p_retailprice]", "tolerance": 5},
        {"name": "price pct", "check": "[l_extendedprice]", "equals": "[l_quantity] * [p_retailprice]", "tolerance_pct": 50},
        {"name": "unit", "check": "[l_extendedprice] / ([l_quantity] - 1)", "equals": "100 * [l_quantity]"},
        {"name": "net", "check": "[l_extendedprice] - [l_extendedprice] * [l_discount]",
         "equals": "[l_extendedprice] * (1 - [l_discount])"}], ["l_partkey"])


def _formula_summary(spark, folder):
    return _checks(spark, folder).summary.withColumn("total_difference", F.round("total_difference", 0))


def _formula_rows(spark, folder):
    m = _checks(spark, folder).mismatches.where(F.col("check").isin("price", "price pct"))
    return m.select("check", "row_in_file", "l_partkey", "value", "expected", "difference", "difference_pct")


def _formula_all(spark, folder):
    """Which rows break which of all four checks."""
    return _checks(spark, folder).mismatches.select("check", "row_in_file", "l_partkey", "value")


_PRICES = "FROM lineitem JOIN part ON l_partkey = p_partkey"


def _formula_summary_sql():
    def line(name, left, right, able, wrong):
        return f"""SELECT '{name}' AS "check", count(*) FILTER (WHERE {able}) AS rows_checked,
            count(*) FILTER (WHERE {able} AND {wrong}) AS mismatches, count(*) FILTER (WHERE NOT {able}) AS could_not_check,
            round(coalesce(sum({left} - {right}) FILTER (WHERE {able} AND {wrong}), 0), 0) AS total_difference {_PRICES}"""
    gap = "abs(l_extendedprice - l_quantity * p_retailprice)"
    unit = "l_extendedprice / nullif(l_quantity - 1, 0)"
    return " UNION ALL ".join([
        line("price", "l_extendedprice", "l_quantity * p_retailprice", "true", f"{gap} > 5"),
        line("price pct", "l_extendedprice", "l_quantity * p_retailprice", "true",
             f"{gap} > 0.01 AND {gap} > l_quantity * p_retailprice * 50 / 100"),
        line("unit", unit, "100 * l_quantity", "(l_quantity <> 1)", f"abs({unit} - 100 * l_quantity) > 0.01"),
        line("net", "l_extendedprice", "l_extendedprice", "true", "false")])


def _dirty(spark, folder):
    """Every dirty customer twice: the second copy differs in nothing."""
    c = customer_dirty(spark, folder)
    n = c.select((F.col("_row") * 2).alias("_row"), *[x for x in c.columns if x != "_row"])
    return n.unionAll(n.withColumn("_row", F.col("_row") + 1))


RULES = [{"column": "balance", "min": 0}, {"column": "segment", "required": True},
         {"column": "nation", "allowed": list(range(20))}]


def _cleaned(spark, folder):
    return clean_table(_dirty(spark, folder), {"rules": RULES})


def _clean_data(spark, folder):
    return _cleaned(spark, folder).data.drop("_row")


def _clean_log(spark, folder):
    return _cleaned(spark, folder).log.select("step", F.col("column").alias("column_name"), "cells_changed", "example_before",
                                              "example_after")


def _clean_problems(spark, folder):
    return _cleaned(spark, folder).problems.select("row_in_file", F.col("column").alias("column_name"), "value", "problem")


def _clean_summary(spark, folder):
    d = _dirty(spark, folder)
    return cleaning_summary(d, clean_table(d, {"rules": RULES}))


def _clean_orders(spark, folder):
    """Dates and prices in mixed forms; what cannot be read would be listed."""
    o = orders_dirty(spark, folder).select("_row", "o_orderkey", "price_text", "date_text")
    c = clean_table(o, {"to_number": ["price_text"], "to_date": ["date_text"]})
    return c.data.select("o_orderkey", F.col("price_text").alias("price"), F.col("date_text").cast("date").alias("day"))


def _clean_replaced(spark, folder):
    """Replacements, then letter case, inside cleaning."""
    cfg = {"replace": {"segment": {"Building": "Construction", " MACHINERY": None}}, "fix_case": {"segment": "upper"}, "unify": False}
    return clean_table(customer_dirty(spark, folder), cfg).data.select("customer_no", "segment")


def _clean_merge(spark, folder):
    made = clean_table(_dirty(spark, folder), {"remove_dups": False, "merge": {
        "key": ["nation"], "how": {"balance": "sum", "segment": "join", "name": "last", "customer_no": "max"}}})
    return made.data.select("nation", F.round("balance", 2).alias("balance"), "segment", "name", "customer_no")


def _unified(spark, folder):
    return unify_spelling(customer_dirty(spark, folder), "segment").select("customer_no", "segment")


def _dedup(spark, folder):
    e = with_row(read(spark, folder, "events"), "event_id").select("_row", "user_id", "event_type")
    return drop_duplicate_rows(e)


def _merge(spark, folder):
    o = with_row(read(spark, folder, "orders"), "o_orderkey").select(
        "_row", "o_custkey", F.col("o_totalprice").alias("total"), F.col("o_totalprice").alias("average"),
        F.col("o_totalprice").alias("least"), F.col("o_totalprice").alias("most"), F.col("o_orderkey").alias("first_order"),
        F.col("o_orderkey").alias("last_order"), F.col("o_orderkey").alias("orders"), F.col("o_orderpriority").alias("kinds"),
        F.col("o_orderstatus").alias("status"))
    m = merge_rows(o, ["o_custkey"], {"total": "sum", "average": "mean", "least": "min", "most": "max", "last_order": "last",
                                      "orders": "count", "kinds": "join"})
    return m.withColumn("total", F.round("total", 2)).withColumn("average", F.round("average", 6))


def _duplicates(spark, folder):
    d = customer_dirty(spark, folder).select("_row", "segment", "nation")
    return duplicate_rows(d)


def _duplicate_counts(spark, folder):
    return exact_and_hidden_duplicates(customer_dirty(spark, folder).select("segment", "nation"))


def _hidden_sql(what):
    rows = """WITH d AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 10 WHEN 0 THEN 'n/a' WHEN 1 THEN lower(c_mktsegment)
        WHEN 2 THEN c_mktsegment[1] || lower(c_mktsegment[2:]) WHEN 3 THEN '  ' || c_mktsegment || ' ' ELSE c_mktsegment END AS s
        FROM customer)"""
    if what == "counts":
        return rows + """ SELECT count(*) - count(DISTINCT (s, c_nationkey)) AS exact,
            count(DISTINCT (s, c_nationkey)) - count(DISTINCT (lower(trim(s)), c_nationkey)) AS hidden FROM d"""
    return rows + """ SELECT c_custkey + 2 AS row_in_file, s AS segment, c_nationkey AS nation FROM d
        QUALIFY count(*) OVER (PARTITION BY lower(trim(s)), c_nationkey) > 1"""


def _quality(spark, folder):
    return check_quality(customer_dirty(spark, folder), as_of=DAY)


def _issues(spark, folder):
    return _quality(spark, folder).issues.select(F.col("column").alias("column_name"), "level", "code", "cells")


def _columns(spark, folder):
    return _quality(spark, folder).columns.select(
        F.col("column").alias("column_name"), "type_found", "filled", "empty", "empty_pct",
        F.col("distinct").alias("n_distinct"), "examples", "min", "max")


def _overview(spark, folder):
    return _quality(spark, folder).overview.select("item", "value")


def _quality_orders(spark, folder):
    o = orders_dirty(spark, folder).select("_row", F.col("o_orderkey").alias("order no"), "price_text", "date_text")
    return check_quality(o, as_of=DAY).issues.select(F.col("column").alias("column_name"), "code", "cells")


def _outliers(spark, folder):
    """Line prices per order: the sums have a long tail."""
    t = read(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice") ** 3 / 1e9, 2).alias("cube"))
    q = check_quality(t.withColumn("_row", F.col("l_orderkey")).select("_row", "cube"), as_of=DAY)
    return q.issues.where("code = 'outlier'").select("code", "cells")


def _check_task(spark, folder):
    made = run_task("check_data", customer_dirty(spark, folder), cleaning={"rules": RULES}, as_of=DAY)
    return made["Summary"]


# dirty customers in SQL, twice over, with their numbers
_D = """d AS (SELECT c_custkey AS k, c_name AS name, c_nationkey AS nation, c_acctbal AS b, c_mktsegment AS s FROM customer),
t AS (SELECT * FROM d UNION ALL SELECT * FROM d)"""

_LOG = f"""WITH {_D}, m AS (SELECT min(k) AS k FROM d WHERE k % 10 = 3), u AS (SELECT min(k) AS k FROM d WHERE k % 10 IN (1, 2))
SELECT 'Placeholder -> empty' AS step, 'segment' AS column_name, count(*) AS cells_changed, '''n/a''' AS example_before,
  NULL::VARCHAR AS example_after FROM t WHERE k % 10 = 0
UNION ALL SELECT 'Trimmed spaces / invisible characters', 'segment', count(*),
  '''  ' || (SELECT s FROM d JOIN m USING (k)) || ' ''', (SELECT s FROM d JOIN m USING (k)) FROM t WHERE k % 10 = 3
UNION ALL SELECT 'Unified spelling variants (case/spaces)', 'segment', count(*),
  '''' || (SELECT CASE WHEN k % 10 = 1 THEN lower(s) ELSE s[1] || lower(s[2:]) END FROM d JOIN u USING (k)) || '''',
  (SELECT s FROM d JOIN u USING (k)) FROM t WHERE k % 10 IN (1, 2)
UNION ALL SELECT 'Text -> number', 'balance', count(*), '''' || (SELECT printf('%,.2f', b) FROM d WHERE k = 0) || '''',
  (SELECT CAST(b AS VARCHAR) FROM d WHERE k = 0) FROM t
UNION ALL SELECT 'Removed identical duplicate rows', '(whole row)', count(*),
  'rows 3, 5, 7, 9, 11, 13, 15, 17, 19, 21, 23, 25, 27, 29, 31 ...', 'removed' FROM d"""

# names and segments that look like typos of each other: the same digits, at least four characters, similar by 88
_TYPOS = f"""w AS (SELECT 'segment' AS c, lower(s) AS v, count(*) AS n FROM d WHERE k % 10 <> 0 GROUP BY 2
    UNION ALL SELECT 'name', lower(name), count(*) FROM d GROUP BY 2),
pairs AS (SELECT DISTINCT p.v AS x, q.v AS y FROM w p JOIN w q ON p.c = q.c AND p.v < q.v AND len(p.v) >= 4 AND len(q.v) >= 4
    AND regexp_replace(p.v, '[^0-9]', '', 'g') = regexp_replace(q.v, '[^0-9]', '', 'g')), {LCS},
typos AS (SELECT p.c, least(p.n, q.n) AS n FROM scored JOIN w p ON p.v = x JOIN w q ON q.v = y AND q.c = p.c WHERE score >= 88)"""

_ISSUES = f"""WITH {_D}, {_TYPOS}, x AS (SELECT quantile_cont(b, 0.25) AS q1, quantile_cont(b, 0.75) AS q3 FROM d),
    i AS (SELECT 'segment' AS column_name, 'Fix' AS level, 'marker' AS code, count(*) FILTER (WHERE k % 10 = 0) AS cells FROM d
    UNION ALL SELECT 'segment', 'Check', 'empty', count(*) FILTER (WHERE k % 10 = 0) FROM d
    UNION ALL SELECT 'segment', 'Fix', 'spaces', count(*) FILTER (WHERE k % 10 = 3) FROM d
    UNION ALL SELECT 'segment', 'Fix', 'variants', count(*) FILTER (WHERE k % 10 <> 0) FROM d
    UNION ALL SELECT 'balance', 'Fix', 'number_text', count(*) FROM d
    UNION ALL SELECT 'balance', 'Check', 'outlier', count(*) FILTER (WHERE b < q1 - 3 * (q3 - q1) OR b > q3 + 3 * (q3 - q1))
      FROM d, x
    UNION ALL SELECT 'balance', 'Check', 'negative', CASE WHEN count(*) FILTER (WHERE b < 0) <= greatest(1, 0.05 * count(*))
      THEN count(*) FILTER (WHERE b < 0) ELSE 0 END FROM d
    UNION ALL SELECT c, 'Check', 'typos', CAST(sum(n) AS BIGINT) FROM typos GROUP BY 1)
    SELECT * FROM i WHERE cells > 0"""

QUERIES = {
    "rule_required": (_required, """SELECT 'A' AS "table", c_custkey + 2 AS row_in_file, 'ref' AS "column", NULL::VARCHAR AS value,
        'Empty, but this column is required' AS problem FROM customer WHERE c_custkey % 13 = 0"""),
    "rule_unique": _rule("events", "event_id", {"column": "user_id", "unique": True},
                         "user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 1)",
                         "Repeated value, but this column must be unique", "CAST(user_id AS VARCHAR)"),
    "rule_min": _rule("customer", "c_custkey", {"column": "c_acctbal", "min": 0}, "c_acctbal < 0", "Must be at least 0",
                      "CAST(c_acctbal AS VARCHAR)"),
    "rule_max": _rule("events", "event_id", {"column": "value", "max": 100}, "value > 100", "Must be at most 100",
                      "CAST(value AS VARCHAR)"),
    "rule_min_date": _rule("orders", "o_orderkey", {"column": "o_orderdate", "min": "1996-01-01"},
                           "o_orderdate < DATE '1996-01-01'", "Must be at least 1996-01-01",
                           "strftime(o_orderdate, '%Y-%m-%d')"),
    "rule_allowed": _rule("orders", "o_orderkey", {"column": "o_orderstatus", "allowed": ["f", "O "]},
                          "o_orderstatus NOT IN ('F', 'O')", "Not an allowed value (f, O )", "o_orderstatus"),
    "rule_pattern": _rule("part", "p_partkey", {"column": "p_brand", "pattern": "Brand#1[0-9]"},
                          "NOT regexp_full_match(p_brand, 'Brand#1[0-9]')",
                          "Does not match the required pattern Brand#1[0-9]", "p_brand"),
    "rule_not_future": _rule("orders", "o_orderkey", {"column": "o_orderdate", "not_future": True},
                             f"o_orderdate > DATE '{DAY}'", "Date is in the future", "strftime(o_orderdate, '%Y-%m-%d')"),
    "rule_not_after": (_not_after, """WITH f AS (SELECT l_orderkey, min(l_shipdate) AS d FROM lineitem GROUP BY 1)
        SELECT 'A' AS "table", o_orderkey + 2 AS row_in_file, 'first_ship' AS "column", strftime(d, '%Y-%m-%d') AS value,
        'Is after/bigger than ''o_orderdate''' AS problem FROM orders JOIN f ON o_orderkey = l_orderkey WHERE d > o_orderdate"""),
    "rules_on_text": (_unread_rules, f"""SELECT row_in_file, "column", problem, "table", value FROM (
        SELECT o_orderkey + 2 AS row_in_file, 'A' AS "table", 'price_text' AS "column", CASE o_orderkey % 6
            WHEN 3 THEN '(' || printf('%.2f', o_totalprice) || ')' WHEN 0 THEN printf('%.2f', o_totalprice)
            WHEN 1 THEN printf('%,.2f', o_totalprice) WHEN 2 THEN 'IQD ' || printf('%,.2f', o_totalprice)
            WHEN 4 THEN printf('%.2f', o_totalprice) || '%'
            ELSE translate(printf('%.2f', o_totalprice), '0123456789.', '٠١٢٣٤٥٦٧٨٩٫') END AS value,
            CASE WHEN o_orderkey % 6 = 3 THEN 'Must be at least 0' ELSE 'Must be at most 400000' END AS problem
        FROM orders WHERE o_orderkey % 6 = 3 OR o_totalprice > 400000
        UNION ALL SELECT o_orderkey + 2, 'A', 'date_text', CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
            WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN day(o_orderdate) || ' ' || (['January', 'Feb', 'Mar',
              'April', 'May', 'Jun', 'July', 'Aug', 'September', 'Oct', 'Nov', 'December'])[month(o_orderdate)] || ' '
              || year(o_orderdate)
            ELSE CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR) END, 'Date is in the future'
        FROM orders WHERE o_orderdate > DATE '{DAY}')"""),
    "formula_summary": (_formula_summary, _formula_summary_sql()),
    "formula_mismatches": (_formula_rows, f"""SELECT c AS "check", l_orderkey * 8 + l_linenumber + 2 AS row_in_file,
        CAST(l_partkey AS VARCHAR) AS l_partkey, l_extendedprice AS value, round_even(e, 4) AS expected,
        round_even(l_extendedprice - e, 4) AS difference, round_even((l_extendedprice - e) / e * 100, 2) AS difference_pct
        FROM (SELECT *, l_quantity * p_retailprice AS e {_PRICES}), (VALUES ('price'), ('price pct')) AS v(c)
        WHERE CASE WHEN c = 'price' THEN abs(l_extendedprice - e) > 5 ELSE abs(l_extendedprice - e) > greatest(0.01, e / 2) END"""),
    "formula_mismatch_rows": (_formula_all, f"""SELECT c AS "check", l_orderkey * 8 + l_linenumber + 2 AS row_in_file,
        CAST(l_partkey AS VARCHAR) AS l_partkey, v AS value FROM (
        SELECT 'price' AS c, *, l_extendedprice AS v {_PRICES} WHERE abs(l_extendedprice - l_quantity * p_retailprice) > 5
        UNION ALL SELECT 'price pct', *, l_extendedprice {_PRICES} WHERE abs(l_extendedprice - l_quantity * p_retailprice)
          > greatest(0.01, l_quantity * p_retailprice / 2)
        UNION ALL SELECT 'unit', *, l_extendedprice / (l_quantity - 1) {_PRICES} WHERE l_quantity <> 1
          AND abs(l_extendedprice / (l_quantity - 1) - 100 * l_quantity) > 0.01
        UNION ALL SELECT 'net', *, l_extendedprice - l_extendedprice * l_discount {_PRICES}
          WHERE abs(l_extendedprice - l_extendedprice * l_discount - l_extendedprice * (1 - l_discount)) > 0.01)"""),
    "clean_table": (_clean_data, """SELECT c_custkey AS customer_no, c_name AS name, CASE WHEN c_custkey % 10 <> 0 THEN
        c_mktsegment END AS segment, c_acctbal AS balance, c_nationkey AS nation FROM customer"""),
    "cleaning_log": (_clean_log, _LOG),
    "cleaning_problems": (_clean_problems, f"""WITH {_D}, n AS (SELECT *, row_number() OVER (PARTITION BY k) - 1 AS copy FROM t)
        SELECT k * 2 + copy + 2 AS row_in_file, 'balance' AS column_name, CAST(b AS VARCHAR) AS value,
          'Must be at least 0' AS problem FROM n WHERE b < 0
        UNION ALL SELECT k * 2 + copy + 2, 'segment', NULL, 'Empty, but this column is required' FROM n WHERE k % 10 = 0
        UNION ALL SELECT k * 2 + copy + 2, 'nation', CAST(nation AS VARCHAR), 'Not an allowed value ('
          || array_to_string(range(20), ', ') || ')' FROM n WHERE nation >= 20"""),
    "cleaning_summary": (_clean_summary, f"""WITH {_D} SELECT CAST((SELECT sum(cells_changed) FROM ({_LOG.replace('WITH ' + _D + ',', 'WITH')})) AS BIGINT)
        AS cells_changed, (SELECT count(*) FILTER (WHERE b < 0) + count(*) FILTER (WHERE k % 10 = 0)
        + count(*) FILTER (WHERE nation >= 20) FROM t) AS data_problems, (SELECT count(*) FROM t) AS rows_before,
        (SELECT count(*) FROM d) AS rows_after"""),
    "clean_orders": (_clean_orders, """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 3 THEN -o_totalprice ELSE o_totalprice END
        AS price, CAST(o_orderdate AS DATE) AS day FROM orders"""),
    "clean_and_merge": (_clean_merge, """WITH f AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS k FROM customer
        WHERE c_custkey % 10 <> 0 GROUP BY 1, 2), j AS (SELECT c_nationkey, string_agg(c_mktsegment, ', ' ORDER BY k) AS seg FROM f
        GROUP BY 1) SELECT c_nationkey AS nation, round(2 * sum(c_acctbal), 2) AS balance, any_value(seg) AS segment,
        arg_max(c_name, c_custkey) AS name, max(c_custkey) AS customer_no FROM customer LEFT JOIN j USING (c_nationkey) GROUP BY 1"""),
    "unify_spelling": (_unified, """SELECT c_custkey AS customer_no, CASE WHEN c_custkey % 10 = 0 THEN 'n/a' ELSE c_mktsegment END
        AS segment FROM customer"""),
    "drop_duplicates": (_dedup, """SELECT min(event_id) AS _row, user_id, event_type FROM events GROUP BY 2, 3"""),
    "merge_rows": (_merge, """WITH p AS (SELECT o_custkey, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY 1, 2),
        j AS (SELECT o_custkey, string_agg(p, ', ' ORDER BY k) AS kinds FROM p GROUP BY 1)
        SELECT min(o_orderkey) AS _row, o_custkey, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS average,
        min(o_totalprice) AS least, max(o_totalprice) AS most, min(o_orderkey) AS first_order, max(o_orderkey) AS last_order,
        count(o_orderkey) AS orders, any_value(kinds) AS kinds, arg_min(o_orderstatus, o_orderkey) AS status
        FROM orders JOIN j USING (o_custkey) GROUP BY o_custkey"""),
    "duplicate_rows": (_duplicates, _hidden_sql("rows")),
    "duplicate_counts": (_duplicate_counts, _hidden_sql("counts")),
    "quality_issues": (_issues, _ISSUES),
    "quality_columns": (_columns, """SELECT 'customer_no' AS column_name, 'number' AS type_found, count(*) AS filled,
          0::BIGINT AS empty, 0.0::DOUBLE AS empty_pct, count(DISTINCT c_custkey) AS n_distinct, '0 | 1 | 2' AS examples,
          min(c_custkey) || '.0' AS min, max(c_custkey) || '.0' AS max FROM customer
        UNION ALL SELECT 'name', 'text - all unique (ID?)', count(*), 0, 0, count(*),
          'Customer#000000000 | Customer#000000001 | Customer#000000002', '', '' FROM customer
        UNION ALL SELECT 'segment', 'text', count(*) FILTER (WHERE c_custkey % 10 <> 0), count(*) FILTER (WHERE c_custkey % 10 = 0),
          round_even(100.0 * count(*) FILTER (WHERE c_custkey % 10 = 0) / count(*), 1),
          count(DISTINCT CASE c_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN lower(c_mktsegment)
             WHEN 2 THEN c_mktsegment[1] || lower(c_mktsegment[2:]) ELSE c_mktsegment END),
          array_to_string(list_transform(list(c_mktsegment ORDER BY c_custkey) FILTER (WHERE c_custkey IN (1, 2, 3)),
             lambda s, i: CASE i WHEN 1 THEN lower(s) WHEN 2 THEN s[1] || lower(s[2:]) ELSE '  ' || s || ' ' END), ' | '),
          '', '' FROM customer
        UNION ALL SELECT 'balance', 'number (stored as text)', count(*), 0, 0, count(DISTINCT c_acctbal),
          array_to_string(list_transform(list(c_acctbal ORDER BY c_custkey) FILTER (WHERE c_custkey < 3),
             lambda b: printf('%,.2f', b)), ' | '), CAST(min(c_acctbal) AS VARCHAR), CAST(max(c_acctbal) AS VARCHAR) FROM customer
        UNION ALL SELECT 'nation', 'number', count(*), 0, 0, count(DISTINCT c_nationkey), (SELECT string_agg(n, ' | ' ORDER BY k)
          FROM (SELECT c_nationkey AS n, min(c_custkey) AS k FROM customer GROUP BY 1 ORDER BY 2 LIMIT 3)),
          min(c_nationkey) || '.0', max(c_nationkey) || '.0' FROM customer"""),
    "quality_overview": (_overview, f"""WITH q AS ({_ISSUES}) SELECT 'Rows' AS item, count(*) AS value FROM customer
        UNION ALL SELECT 'Columns', 5 UNION ALL SELECT 'Empty cells', count(*) FROM customer WHERE c_custkey % 10 = 0
        UNION ALL SELECT 'Identical duplicate rows', 0 UNION ALL SELECT 'Hidden duplicates (spaces/case)', 0
        UNION ALL SELECT 'Problems to fix', count(*) FROM q WHERE level = 'Fix'
        UNION ALL SELECT 'Things to check', count(*) FROM q WHERE level = 'Check'"""),
    "quality_text_dates": (_quality_orders, f"""WITH t AS (SELECT o_orderkey AS k, o_orderdate AS d,
          CASE WHEN o_orderkey % 6 = 3 THEN -o_totalprice ELSE o_totalprice END AS x FROM orders),
        e AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM t),
        g AS (SELECT lower(day(d) || ' ' || (['January', 'Feb', 'Mar', 'April', 'May', 'Jun', 'July', 'Aug', 'September', 'Oct', 'Nov',
          'December'])[month(d)] || ' ' || year(d)) AS v, count(*) AS n FROM t WHERE k % 4 = 2 GROUP BY 1),
        pairs AS (SELECT p.v AS x, q.v AS y FROM g p JOIN g q ON p.v < q.v
          AND regexp_replace(p.v, '[^0-9]', '', 'g') = regexp_replace(q.v, '[^0-9]', '', 'g')), {LCS},
        i AS (SELECT 'price_text' AS column_name, 'number_text' AS code, count(*) AS cells FROM t
        UNION ALL SELECT 'price_text', 'outlier', count(*) FILTER (WHERE x < q1 - 3 * (q3 - q1) OR x > q3 + 3 * (q3 - q1)) FROM t, e
        UNION ALL SELECT 'price_text', 'negative', CASE WHEN count(*) FILTER (WHERE x < 0) <= greatest(1, 0.05 * count(*))
          THEN count(*) FILTER (WHERE x < 0) ELSE 0 END FROM t
        UNION ALL SELECT 'date_text', 'mixed_types', count(*) FROM t
        UNION ALL SELECT 'date_text', 'typos', CAST(sum(CASE WHEN p.n > q.n OR p.n = q.n THEN q.n ELSE p.n END) AS BIGINT)
          FROM scored JOIN g p ON p.v = x JOIN g q ON q.v = y WHERE score >= 88)
        SELECT * FROM i WHERE cells > 0"""),
    "quality_outliers": (_outliers, """WITH t AS (SELECT round(sum(l_extendedprice) ** 3 / 1e9, 2) AS c FROM lineitem
        GROUP BY l_orderkey), x AS (SELECT quantile_cont(c, 0.25) AS q1, quantile_cont(c, 0.75) AS q3 FROM t)
        SELECT 'outlier' AS code, count(*) AS cells FROM t, x WHERE c < q1 - 3 * (q3 - q1) OR c > q3 + 3 * (q3 - q1)"""),
    "check_task_summary": (_check_task, f"""WITH q AS ({_ISSUES}), {_D}, {_TYPOS}
        SELECT 'Problems to fix' AS item, CAST(count(*) FILTER (WHERE level = 'Fix') AS VARCHAR) AS value FROM q
        UNION ALL SELECT 'Things to check', CAST(count(*) FILTER (WHERE level = 'Check') AS VARCHAR) FROM q
        UNION ALL SELECT 'Possible typos (similar spellings)', CAST(count(*) AS VARCHAR) FROM typos
        UNION ALL SELECT 'Cells cleaning would change', CAST(count(*) + count(*) FILTER (WHERE c_custkey % 10 < 4) AS VARCHAR) FROM customer
        UNION ALL SELECT 'Fix-level problems left after cleaning', '0'
        UNION ALL SELECT 'Data problems (rules / unreadable values)', CAST(count(*) FILTER (WHERE c_acctbal < 0)
          + count(*) FILTER (WHERE c_custkey % 10 = 0) + count(*) FILTER (WHERE c_nationkey >= 20) AS VARCHAR) FROM customer"""),
    "clean_with_replacements": (_clean_replaced, """SELECT c_custkey AS customer_no, CASE WHEN c_custkey % 10 = 0 THEN NULL
        WHEN lower(c_mktsegment) = 'building' THEN 'CONSTRUCTION' WHEN lower(c_mktsegment) = 'machinery' THEN NULL
        ELSE upper(c_mktsegment) END AS segment FROM customer"""),
}
