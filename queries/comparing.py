"""Exact and fuzzy comparison of tables, columns and rows."""

from pyspark.sql import functions as F

from tabwright.operators import (compare_columns, compare_rows, compare_schema, exact_compare, find_row, fuzzy_compare,
                                 preview, profile_columns, rowwise_compare, similar_values, value_overlap)
from tabwright.operators.candidates import similar_texts
from tabwright.operators.compare import column_compare_summary, key_warning, row_compare_summary
from tabwright.operators.values import value_table

from .inputs import CUSTOMER_RESTATED, customer_restated, parts_mistyped, parts_named, read, with_row


def _pair(spark, folder, tolerance=0.0):
    """Customers against their restated copy: keys as text, some missing; balances and segments changed."""
    return exact_compare(read(spark, folder, "customer"), customer_restated(spark, folder), ["c_custkey"], ["ref"],
                         {"c_acctbal": "balance", "c_mktsegment": "segment"}, tolerance, True)


def _only_a(spark, folder):
    return _pair(spark, folder).only_a


def _only_b(spark, folder):
    return _pair(spark, folder).only_b


def _matched(spark, folder):
    return _pair(spark, folder).matched.select("c_custkey", F.col("`c_acctbal (A)`").alias("a"),
                                               F.col("`c_acctbal (B)`").alias("b"), "changed")


def _diffs(spark, folder):
    d = _pair(spark, folder).diffs
    return d.select("c_custkey", F.col("column").alias("column_name"), "value_a", "value_b",
                    F.round("difference", 2).alias("difference"))


def _stats(tolerance):
    def run(spark, folder):
        return _pair(spark, folder, tolerance).stats

    wrong = "abs(c_acctbal - balance) > 0.5" if tolerance == 0.5 else (
        "abs(c_acctbal - balance) > 1.5" if tolerance else "c_acctbal <> balance")
    return run, f"""WITH {CUSTOMER_RESTATED}, j AS (SELECT * FROM customer JOIN restated ON CAST(c_custkey AS VARCHAR) = ref)
SELECT (SELECT count(*) FROM customer) AS rows_a, (SELECT count(*) FROM restated) AS rows_b, count(*) AS matched,
  count(*) FILTER (WHERE {wrong} OR lower(c_mktsegment) <> lower(segment)) AS matched_changed,
  (SELECT count(*) FROM customer WHERE c_custkey % 13 = 0) AS only_a, (SELECT count(*) FROM restated WHERE ref = '') AS only_b,
  0::BIGINT AS dup_a, greatest((SELECT count(*) FROM restated WHERE ref = '') - 1, 0) AS dup_b FROM j"""


def _order_lines(spark, folder):
    """Orders against the totals of their lines."""
    o = read(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    li = read(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"))
    return exact_compare(o, li, ["o_orderkey"], ["o_orderkey"])


def _order_diffs(spark, folder):
    return _order_lines(spark, folder).diffs.select(F.col("o_orderkey").alias("order_no"),
                                                    F.round("difference", 2).alias("difference"))


def _order_stats(spark, folder):
    return _order_lines(spark, folder).stats


def _many_to_many(spark, folder):
    """Repeated keys on one side: events per user against customers."""
    e = read(spark, folder, "events").select(F.col("user_id").alias("k"), "value")
    c = read(spark, folder, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("value"))
    return exact_compare(e, c, ["k"], ["k"])


def _dup_stats(spark, folder):
    return _many_to_many(spark, folder).stats


def _dup_warning(spark, folder):
    return key_warning(_many_to_many(spark, folder).stats)


def _schema(spark, folder):
    c, s = read(spark, folder, "customer"), read(spark, folder, "supplier")
    return compare_schema(c.withColumnRenamed("c_nationkey", "nation"), s.withColumnRenamed("s_nationkey", "nation"))


def _overlap(part):
    def run(spark, folder):
        o = value_overlap(read(spark, folder, "supplier"), "s_suppkey", customer_restated(spark, folder), "ref")
        return getattr(o, part)
    return run


def _overlap_sql(test):
    return f"""WITH {CUSTOMER_RESTATED}, a AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS v FROM supplier),
        b AS (SELECT DISTINCT ref AS v FROM restated WHERE ref <> '') SELECT v AS value FROM {test}"""


def _rowwise(spark, folder):
    c = with_row(read(spark, folder, "customer"), "c_custkey")
    s = with_row(read(spark, folder, "supplier"), "s_suppkey")
    return rowwise_compare(c, "c_acctbal", s, "s_acctbal", 1000.0).select(
        "row", "value_a", "value_b", "same", F.round("difference", 2).alias("difference"))


def _columns_summary(spark, folder):
    c = with_row(read(spark, folder, "customer"), "c_custkey")
    s = with_row(read(spark, folder, "supplier"), "s_suppkey")
    return column_compare_summary(value_overlap(c, "c_nationkey", s, "s_nationkey"),
                                  rowwise_compare(c, "c_nationkey", s, "s_nationkey"))


def _find(spark, folder):
    e = with_row(read(spark, folder, "events"), "event_id")
    return find_row(e, "event_type", " PURCHASE ").select("event_id", "user_id", "value", "hits")


def _find_date(spark, folder):
    o = with_row(read(spark, folder, "orders"), "o_orderkey")
    return find_row(o, "o_orderdate", "1997-05-28").select("o_orderkey", "o_totalprice", "hits")


def _records(spark, folder):
    o = with_row(read(spark, folder, "orders"), "o_orderkey")
    return compare_rows(o, "row_number", 3, o, "o_orderstatus", "p", {"o_orderkey": "o_custkey"}).select(
        F.col("column").alias("column_name"), "row_a", "row_b", "same")


def _records_summary(spark, folder):
    o = with_row(read(spark, folder, "orders"), "o_orderkey")
    return row_compare_summary(compare_rows(o, "row_number", 3, o, "o_orderstatus", "p"))


_RECORDS = """WITH a AS (SELECT * FROM orders WHERE o_orderkey = 3),
b AS (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1),
r AS (SELECT '{0}' AS column_name, CAST(a.o_orderkey AS VARCHAR) AS row_a, CAST(b.{1} AS VARCHAR) AS row_b FROM a, b
UNION ALL SELECT 'o_custkey', CAST(a.o_custkey AS VARCHAR), CAST(b.o_custkey AS VARCHAR) FROM a, b
UNION ALL SELECT 'o_orderstatus', a.o_orderstatus, b.o_orderstatus FROM a, b
UNION ALL SELECT 'o_totalprice', CAST(a.o_totalprice AS VARCHAR), CAST(b.o_totalprice AS VARCHAR) FROM a, b
UNION ALL SELECT 'o_orderdate', CAST(CAST(a.o_orderdate AS DATE) AS VARCHAR), CAST(CAST(b.o_orderdate AS DATE) AS VARCHAR) FROM a, b
UNION ALL SELECT 'o_orderpriority', a.o_orderpriority, b.o_orderpriority FROM a, b)"""


def _profile(table):
    def run(spark, folder):
        p = profile_columns(read(spark, folder, table))
        return p.select(F.col("column").alias("column_name"), "rows", "empty", F.col("distinct").alias("n_distinct"),
                        "earliest", "latest", F.round("sum", 2).alias("total"), F.round("average", 4).alias("average"),
                        "min", "max", "most_common")
    return run


def _profile_sql(table, numbers, dates, texts):
    def line(c, total="NULL::DOUBLE", avg="NULL::DOUBLE", lo="NULL::DOUBLE", hi="NULL::DOUBLE", d0="NULL::VARCHAR",
             d1="NULL::VARCHAR", mode="NULL::VARCHAR"):
        return f"""SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS empty,
            count(DISTINCT {c}) AS n_distinct, {d0} AS earliest, {d1} AS latest, {total} AS total, {avg} AS average,
            {lo} AS min, {hi} AS max, {mode} AS most_common FROM {table}"""
    out = [line(c, f"round(CAST(sum({c}) AS DOUBLE), 2)", f"round(avg({c}), 4)", f"CAST(min({c}) AS DOUBLE)",
                f"CAST(max({c}) AS DOUBLE)") for c in numbers]
    out += [line(c, d0=f"strftime(min({c}), '%Y-%m-%d')", d1=f"strftime(max({c}), '%Y-%m-%d')") for c in dates]
    out += [line(c, mode=f"(SELECT {c} FROM {table} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)") for c in texts]
    return " UNION ALL ".join(out)


def _column_pair(spark, folder):
    return compare_columns(read(spark, folder, "customer"), "c_mktsegment", read(spark, folder, "orders"), "o_orderpriority")


def _preview(spark, folder):
    return preview(with_row(read(spark, folder, "orders"), "o_orderkey"), 100).drop("_row")


# Longest common subsequence of two texts in SQL: one row of the table per letter, its prefix maxima by list
# functions; score as a whole percentage, the plain ratio.
LCS = """
chars AS (SELECT *, string_split(x, '') AS cx, string_split(y, '') AS cy FROM pairs),
lcs AS (SELECT x, y, list_last(list_reduce(list_prepend([0 FOR i IN range(len(y) + 1)], [[ascii(c)] FOR c IN cx]),
    lambda row, ch: [list_max([greatest(row[j], CASE WHEN j > 1 AND ascii(cy[j - 1]) = ch[1] THEN row[j - 1] + 1 ELSE 0 END)
                     FOR j IN range(1, k + 1)]) FOR k IN range(1, len(y) + 2)])) AS n FROM chars),
scored AS (SELECT x, y, CAST(floor(100.0 * 2 * n / (len(x) + len(y)) + 0.5) AS INTEGER) AS score FROM lcs)"""


def _scores(spark, folder):
    """All pairs of distinct part names and mistyped names that score 80 or more."""
    a = parts_named(spark, folder).groupBy(F.col("p_name").alias("text")).count()
    b = parts_mistyped(spark, folder).groupBy(F.col("item").alias("text")).count()
    nodes = [x.select(F.xxhash64("text").alias("id"), F.lit("").alias("block"), "text") for x in (a, b)]
    pairs = similar_texts(*nodes, 80, "simple", compact=False)
    left, right = [n.select(F.col("id").alias(i), F.col("text").alias(t)) for n, i, t in
                   zip(nodes, ("id_a", "id_b"), ("name", "mistyped"))]
    return pairs.join(left, "id_a").join(right, "id_b").select("name", "mistyped", "score")


_ITEM = """CASE WHEN p_partkey % 7 = 0 THEN 'unlisted ' || p_type ELSE
    p_name[:p_partkey % len(p_name)] || p_name[p_partkey % len(p_name) + 2:] END"""
_SCORES = f"""WITH a AS (SELECT DISTINCT p_name AS x FROM part), b AS (SELECT DISTINCT {_ITEM} AS y FROM part),
pairs AS (SELECT x, y FROM a, b), {LCS} SELECT x AS name, y AS mistyped, score FROM scored WHERE score >= 80"""


def _typos(spark, folder):
    names = parts_mistyped(spark, folder).select("item")
    out = similar_values(value_table(names), 90, None)
    return out.select("value", "count", "similar_value", "similar_count", "similarity_pct")


_TYPOS = f"""WITH n AS (SELECT {_ITEM} AS v FROM part),
g AS (SELECT trim(regexp_replace(v, '\\s+', ' ', 'g')) AS v, count(*) AS n FROM n GROUP BY 1),
pairs AS (SELECT p.v AS x, q.v AS y FROM g p JOIN g q ON p.v < q.v WHERE len(p.v) >= 4 AND len(q.v) >= 4), {LCS}
SELECT CASE WHEN p.n >= q.n THEN x ELSE y END AS value, CASE WHEN p.n >= q.n THEN p.n ELSE q.n END AS count,
       CASE WHEN p.n >= q.n THEN y ELSE x END AS similar_value, CASE WHEN p.n >= q.n THEN q.n ELSE p.n END AS similar_count,
       score AS similarity_pct
FROM scored JOIN g p ON p.v = x JOIN g q ON q.v = y WHERE score >= 90"""


def _fuzzy(spark, folder, **options):
    """Parts against mistyped parts of the same brand and size, by name."""
    return fuzzy_compare(parts_named(spark, folder), parts_mistyped(spark, folder), ["p_name"], ["item"],
                         {"p_retailprice": "price"}, must_match={"p_brand": "p_brand", "p_size": "p_size"},
                         **options)


def _fuzzy_matches(spark, folder):
    m = _fuzzy(spark, folder).matches
    return m.select("row_in_a_file", "row_in_b_file", F.col("`p_name (A)`").alias("name"), F.col("`item (B)`").alias("item"),
                    "similarity_pct", "match_type", "needs_review", F.col("values").alias("verdict"))


def _fuzzy_rounds(spark, folder):
    """The same pairs by rounds alone, without the finishing step."""
    return _fuzzy(spark, folder, most_in_task=0).pairs


def _fuzzy_diffs(spark, folder):
    d = _fuzzy(spark, folder).diffs
    return d.select(F.col("`p_name (A)`").alias("name"), F.col("`item (B)`").alias("item"), "similarity_pct",
                    F.col("column").alias("column_name"), "value_a", "value_b", F.round("difference", 2).alias("difference"))


def _fuzzy_left(side):
    def run(spark, folder):
        return getattr(_fuzzy(spark, folder), side)
    return run


def _fuzzy_stats(spark, folder):
    return _fuzzy(spark, folder).stats


def _fuzzy_sets(spark, folder):
    """Word-set matching of brand, name and kind against the name alone, within a size."""
    p = read(spark, folder, "part")
    a = p.select(F.col("p_partkey").alias("_row"), F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("full"), "p_size")
    b = p.select(F.col("p_partkey").alias("_row"), F.concat_ws(" ", "p_name", "p_brand").alias("short"), "p_size")
    return fuzzy_compare(a, b, ["full"], ["short"], threshold=95, method="token_set",
                         must_match={"p_size": "p_size"}).pairs


# Greedy assignment in SQL, row by row: in every round take the pairs that come first for both of their rows.
_FUZZY = f"""WITH RECURSIVE ra AS (SELECT p_partkey AS r, p_name AS name, lower(trim(p_name)) AS t, p_brand AS k1, p_size AS k2,
    p_retailprice AS price FROM part),
rb AS (SELECT p_partkey AS r, {_ITEM} AS name, trim(regexp_replace(lower({_ITEM}), '\\s+', ' ', 'g')) AS t, p_brand AS k1,
    p_size AS k2, p_retailprice + CASE WHEN p_partkey % 5 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS price FROM part),
texts AS (SELECT DISTINCT ra.t AS ta, rb.t AS tb FROM ra JOIN rb USING (k1, k2)),
forms AS (SELECT ta, tb, array_to_string(list_sort(string_split(ta, ' ')), ' ') AS x,
                 array_to_string(list_sort(string_split(tb, ' ')), ' ') AS y FROM texts
    UNION ALL SELECT ta, tb, replace(ta, ' ', ''), replace(tb, ' ', '') FROM texts),
pairs AS (SELECT DISTINCT x, y FROM forms), {LCS},
best AS (SELECT ta, tb, max(score) AS score FROM forms JOIN scored USING (x, y) GROUP BY 1, 2),
near AS (SELECT ra.r AS a, rb.r AS b, score FROM ra JOIN rb USING (k1, k2) JOIN best ON ta = ra.t AND tb = rb.t),
steps(a, b, score, picked) AS (SELECT a, b, score, false FROM near WHERE score >= 85
    UNION ALL (WITH open AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS ka,
                               row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS kb FROM steps WHERE NOT picked),
               hit AS (SELECT a, b, score FROM open WHERE ka = 1 AND kb = 1)
     SELECT a, b, score, true FROM hit UNION ALL SELECT a, b, score, false FROM open
     WHERE a NOT IN (SELECT a FROM hit) AND b NOT IN (SELECT b FROM hit))),
m AS (SELECT a, b, score FROM steps WHERE picked),
j AS (SELECT m.*, ra.name AS na, rb.name AS nb, ra.price AS pa, rb.price AS pb FROM m JOIN ra ON ra.r = a JOIN rb ON rb.r = b)"""


def _fuzzy_left_sql(side):
    mine, theirs, cols = ("a", "b", "p_name, p_brand, p_size, p_retailprice") if side == "only_a" else ("b", "a", "item, p_brand, p_size, price")
    names = "name AS p_name, k1 AS p_brand, k2 AS p_size, price AS p_retailprice" if side == "only_a" else (
        "name AS item, k1 AS p_brand, k2 AS p_size, price")
    return f"""{_FUZZY}, n AS (SELECT {mine} AS r, arg_max({theirs}, (score, -{theirs})) AS o, max(score) AS s FROM near GROUP BY 1)
        SELECT r{mine}.r + 2 AS row_in_file, {names.replace('name', f'r{mine}.name').replace(f'p_r{mine}.name', 'p_name').replace('k1', f'r{mine}.k1').replace('k2', f'r{mine}.k2').replace('price', f'r{mine}.price').replace(f'p_retailr{mine}.price', 'p_retailprice')},
        o.name AS closest, s AS closest_pct FROM r{mine} LEFT JOIN n ON n.r = r{mine}.r LEFT JOIN r{theirs} o ON o.r = n.o
        WHERE r{mine}.r NOT IN (SELECT {mine} FROM m)"""


QUERIES = {
    "reconcile_only_a": (_only_a, """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_acctbal, c_mktsegment FROM customer
        WHERE c_custkey % 13 = 0"""),
    "reconcile_only_b": (_only_b, f"""WITH {CUSTOMER_RESTATED} SELECT ref AS c_custkey, balance AS c_acctbal,
        segment AS c_mktsegment FROM restated WHERE ref = ''"""),
    "reconcile_matched": (_matched, f"""WITH {CUSTOMER_RESTATED} SELECT ref AS c_custkey, c_acctbal AS a, balance AS b,
        c_acctbal <> balance OR lower(c_mktsegment) <> lower(segment) AS changed
        FROM customer JOIN restated ON CAST(c_custkey AS VARCHAR) = ref"""),
    "reconcile_diffs": (_diffs, f"""WITH {CUSTOMER_RESTATED}, j AS (SELECT * FROM customer JOIN restated
        ON CAST(c_custkey AS VARCHAR) = ref)
        SELECT ref AS c_custkey, 'c_acctbal' AS column_name, CAST(c_acctbal AS VARCHAR) AS value_a,
          CAST(balance AS VARCHAR) AS value_b, round(balance - c_acctbal, 2) AS difference FROM j WHERE c_acctbal <> balance
        UNION ALL SELECT ref, 'c_mktsegment', c_mktsegment, segment, NULL FROM j
          WHERE lower(c_mktsegment) <> lower(segment)"""),
    "reconcile_stats": _stats(0.0),
    "reconcile_stats_tolerance": _stats(1.5),
    "reconcile_orders_diffs": (_order_diffs, """WITH t AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS s FROM lineitem
        GROUP BY 1) SELECT CAST(o_orderkey AS VARCHAR) AS order_no, round(s - o_totalprice, 2) AS difference
        FROM orders JOIN t ON o_orderkey = l_orderkey WHERE s <> o_totalprice"""),
    "reconcile_orders_stats": (_order_stats, """WITH t AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS s FROM lineitem
        GROUP BY 1) SELECT (SELECT count(*) FROM orders) AS rows_a, (SELECT count(*) FROM t) AS rows_b, count(*) AS matched,
        count(*) FILTER (WHERE s <> o_totalprice) AS matched_changed, (SELECT count(*) FROM orders) - count(*) AS only_a,
        (SELECT count(*) FROM t) - count(*) AS only_b, 0::BIGINT AS dup_a, 0::BIGINT AS dup_b
        FROM orders JOIN t ON o_orderkey = l_orderkey"""),
    "reconcile_repeated_keys": (_dup_stats, """SELECT (SELECT count(*) FROM events) AS rows_a, (SELECT count(*) FROM customer)
        AS rows_b, count(*) AS matched, count(*) FILTER (WHERE value <> c_acctbal) AS matched_changed,
        (SELECT count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)) AS only_a,
        (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)) AS only_b,
        (SELECT count(*) - count(DISTINCT user_id) FROM events) AS dup_a, 0::BIGINT AS dup_b
        FROM events JOIN customer ON user_id = c_custkey"""),
    "reconcile_warning": (_dup_warning, """SELECT 'Key not unique (duplicates A=' || (count(*) - count(DISTINCT user_id))
        || ', B=0)' AS warning FROM events"""),
    "schema_compare": (_schema, """SELECT * FROM (VALUES (0, 'c_custkey', 'Only in A', 'bigint', ''),
        (1, 'c_name', 'Only in A', 'string', ''), (2, 'nation', 'In both', 'int', 'int'),
        (3, 'c_acctbal', 'Only in A', 'double', ''), (4, 'c_mktsegment', 'Only in A', 'string', ''),
        (5, 's_suppkey', 'Only in B', '', 'bigint'), (6, 's_name', 'Only in B', '', 'string'),
        (7, 's_acctbal', 'Only in B', '', 'double')) AS t(position, "column", status, type_a, type_b)"""),
    "overlap_both": (_overlap("both"), _overlap_sql("(SELECT v FROM a INTERSECT SELECT v FROM b)")),
    "overlap_only_a": (_overlap("only_a"), _overlap_sql("(SELECT v FROM a EXCEPT SELECT v FROM b)")),
    "overlap_only_b": (_overlap("only_b"), _overlap_sql("(SELECT v FROM b EXCEPT SELECT v FROM a)")),
    "rowwise_compare": (_rowwise, """SELECT c_custkey AS row, c_acctbal AS value_a, s_acctbal AS value_b,
        abs(c_acctbal - s_acctbal) <= 1000 AS same, round(s_acctbal - c_acctbal, 2) AS difference
        FROM customer JOIN supplier ON c_custkey = s_suppkey"""),
    "column_compare_summary": (_columns_summary, """WITH a AS (SELECT DISTINCT c_nationkey AS v FROM customer),
        b AS (SELECT DISTINCT s_nationkey AS v FROM supplier)
        SELECT 'Values in both' AS item, (SELECT count(*) FROM a WHERE v IN (SELECT v FROM b)) AS value
        UNION ALL SELECT 'Values only in A', (SELECT count(*) FROM a WHERE v NOT IN (SELECT v FROM b))
        UNION ALL SELECT 'Values only in B', (SELECT count(*) FROM b WHERE v NOT IN (SELECT v FROM a))
        UNION ALL SELECT 'Rows that differ (by position)', (SELECT count(*) FROM customer JOIN supplier
            ON c_custkey = s_suppkey WHERE c_nationkey <> s_nationkey)"""),
    "find_row": (_find, """SELECT arg_min(event_id, event_id) AS event_id, arg_min(user_id, event_id) AS user_id,
        arg_min(value, event_id) AS value, count(*) AS hits FROM events WHERE event_type = 'purchase'"""),
    "find_row_by_day": (_find_date, """SELECT min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice,
        count(*) AS hits FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1997-05-28' HAVING count(*) > 0"""),
    "compare_rows": (_records, _RECORDS.format("o_orderkey <-> o_custkey", "o_custkey") + """
        SELECT *, lower(row_a) = lower(row_b) AS same FROM r"""),
    "compare_rows_summary": (_records_summary, _RECORDS.format("o_orderkey", "o_orderkey") + """
        SELECT count(*) AS compared_columns, count(*) FILTER (WHERE lower(row_a) <> lower(row_b)) AS columns_that_differ
        FROM r"""),
    "profile_orders": (_profile("orders"), _profile_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderdate"],
                                                        ["o_orderstatus", "o_orderpriority"])),
    "profile_events": (_profile("events"), _profile_sql("events", ["event_id", "user_id", "value"], ["ts"],
                                                        ["event_type", "props"])),
    "compare_columns": (_column_pair, """SELECT * FROM (SELECT 'Rows' AS metric, CAST((SELECT count(*) FROM customer) AS VARCHAR)
        AS value_a, CAST((SELECT count(*) FROM orders) AS VARCHAR) AS value_b UNION ALL SELECT 'Empty', '0', '0'
        UNION ALL SELECT 'Distinct values', CAST((SELECT count(DISTINCT c_mktsegment) FROM customer) AS VARCHAR),
          CAST((SELECT count(DISTINCT o_orderpriority) FROM orders) AS VARCHAR)
        UNION ALL SELECT 'Most common', (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
          (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))"""),
    "preview": (_preview, "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100"),
    "similarity_scores": (_scores, _SCORES),
    "similar_values": (_typos, _TYPOS),
    "fuzzy_matches": (_fuzzy_matches, _FUZZY + """ SELECT a + 2 AS row_in_a_file, b + 2 AS row_in_b_file, na AS name, nb AS item,
        score AS similarity_pct, CASE WHEN lower(na) = lower(trim(nb)) THEN 'Identical' WHEN score = 100 THEN
        'Same after cleaning' ELSE 'Similar' END AS match_type, CASE WHEN score < 95 THEN 'Yes' ELSE '' END AS needs_review,
        CASE WHEN pa = pb THEN 'All same' ELSE '1 different' END AS verdict FROM j"""),
    "fuzzy_rounds": (_fuzzy_rounds, _FUZZY + " SELECT a AS row_a, b AS row_b, score FROM m"),
    "fuzzy_diffs": (_fuzzy_diffs, _FUZZY + """ SELECT na AS name, nb AS item, score AS similarity_pct,
        'p_retailprice <-> price' AS column_name, CAST(pa AS VARCHAR) AS value_a, CAST(pb AS VARCHAR) AS value_b,
        round(pb - pa, 2) AS difference FROM j WHERE pa <> pb"""),
    "fuzzy_only_a": (_fuzzy_left("only_a"), _fuzzy_left_sql("only_a")),
    "fuzzy_only_b": (_fuzzy_left("only_b"), _fuzzy_left_sql("only_b")),
    "fuzzy_stats": (_fuzzy_stats, _FUZZY + """ SELECT (SELECT count(*) FROM ra) AS rows_a, (SELECT count(*) FROM rb) AS rows_b,
        count(*) AS matched_pairs, count(*) FILTER (WHERE score < 95) AS needing_review,
        count(*) FILTER (WHERE pa <> pb) AS with_different_values, (SELECT count(*) FROM ra) - count(*) AS only_in_a,
        (SELECT count(*) FROM rb) - count(*) AS only_in_b FROM j"""),
    "fuzzy_word_sets": (_fuzzy_sets, None),
}
