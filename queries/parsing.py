"""Values read out of text and texts made comparable."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions import (formula, letter_case, marker_to_null, match_text, norm_text, parse_date, parse_number,
                                 plain_number, replace_values, tidy_spaces, values_equal)
from tabwright.functions.text import typed
from tabwright.operators.rows import distinct_values, keep_values

from .inputs import customer_dirty, customer_restated, orders_dirty, read

TEXT = T.StringType()
SPACES = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
INVISIBLE = r"[\x{200B}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"


def _numbers(spark, folder):
    return orders_dirty(spark, folder).select("o_orderkey", parse_number(F.col("price_text"), TEXT).alias("value"))


def _numbers_comma(spark, folder):
    text = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    return read(spark, folder, "orders").select("o_orderkey", parse_number(text, TEXT, ",").alias("value"))


def _numbers_strict(spark, folder):
    return orders_dirty(spark, folder).select("o_orderkey", plain_number(F.col("price_text"), TEXT).alias("value"))


def _dates(day_first):
    def run(spark, folder):
        return orders_dirty(spark, folder).select(
            "o_orderkey", parse_date(F.col("date_text"), TEXT, day_first).cast("date").alias("day"))
    return run


def _tidy(spark, folder):
    d = read(spark, folder, "documents").select("doc_id", tidy_spaces(F.col("text")).alias("t"))
    return d.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n"))


def _match(spark, folder):
    d = read(spark, folder, "documents").select("doc_id", match_text(F.col("text"), TEXT, ["the", "le"]).alias("t"))
    return d.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n"))


def _norm(spark, folder):
    c = read(spark, folder, "customer")
    o = customer_restated(spark, folder).select("ref", "_row")
    j = c.join(o, F.col("c_custkey") == F.col("_row"))
    return j.select("c_custkey", norm_text(F.col("ref"), TEXT).alias("ref"),
                    norm_text(*typed(c, "c_acctbal")).alias("balance"), norm_text(*typed(c, "c_name"), True).alias("name"))


def _markers(spark, folder):
    return customer_dirty(spark, folder).select("customer_no", marker_to_null(F.col("segment")).alias("segment"))


def _replaced(spark, folder):
    mapping = {"building": "Construction", " AUTOMOBILE ": "Cars", "n/a": None}
    return customer_dirty(spark, folder).select("customer_no", replace_values(F.col("segment"), mapping).alias("segment"))


def _cases(spark, folder):
    p = read(spark, folder, "part")
    text = F.concat_ws("-", "p_name", "p_type")
    return p.select("p_partkey", *[letter_case(text, m).alias(m) for m in ("upper", "lower", "title")])


def _equal(spark, folder):
    c = read(spark, folder, "customer")
    o = customer_restated(spark, folder)
    j = c.join(o, F.col("c_custkey") == F.col("_row"))
    return j.select("c_custkey", values_equal(typed(c, "c_acctbal"), typed(o, "balance"), 0.5).alias("balance_same"),
                    values_equal(typed(c, "c_mktsegment"), typed(o, "segment"), 0, True).alias("segment_same"),
                    values_equal(typed(c, "c_custkey"), typed(o, "ref")).alias("key_same"))


def _formula(spark, folder):
    li = read(spark, folder, "lineitem")
    made = formula(li, "[l_extendedprice] * (1 - [l_discount]) / ([l_quantity] - 1)")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", made.alias("value"))


def _kept(spark, folder):
    return keep_values(read(spark, folder, "orders"), "o_orderpriority", ["1-URGENT", "5-LOW"]).select(
        "o_orderkey", "o_orderpriority")


def _distinct(spark, folder):
    return distinct_values(customer_restated(spark, folder), "segment")


def _date_forms(spark, folder):
    """Order dates written in seven more forms, with a time of day in some; the month alone in the last."""
    o = read(spark, folder, "orders")
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("make_dt_interval(0, cast(o_orderkey % 24 as int), cast(o_orderkey % 60 as int), 0)")
    forms = ["dd/MM/yyyy h:mm a", "yyyyMMdd", "MMM-dd-yyyy", "yyyy-MMM-dd", "EEEE, d MMMM yyyy", "MMMM d, yyyy hh:mm:ss a", "MMMM yyyy"]
    text = F.element_at(F.array(*[F.date_format(at, f) for f in forms]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return o.select("o_orderkey", parse_date(text, TEXT).cast("string").alias("moment"))


QUERIES = {
    "parse_numbers": (_numbers, """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 3 THEN -o_totalprice ELSE o_totalprice END
        AS value FROM orders"""),
    "parse_numbers_comma": (_numbers_comma, "SELECT o_orderkey, o_totalprice AS value FROM orders"),
    "parse_numbers_strict": (_numbers_strict, """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 OR
        (o_orderkey % 6 = 1 AND o_totalprice < 999.995) THEN o_totalprice END AS value FROM orders"""),
    "parse_dates": (_dates(True), "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders"),
    "parse_dates_month_first": (_dates(False), """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 AND day(o_orderdate) <= 12
        THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)) ELSE CAST(o_orderdate AS DATE) END AS day
        FROM orders"""),
    "parse_date_forms": (_date_forms, """SELECT o_orderkey, strftime(CASE o_orderkey % 7 WHEN 6 THEN date_trunc('month', o_orderdate)
        WHEN 0 THEN o_orderdate + to_minutes(o_orderkey % 24 * 60 + o_orderkey % 60)
        WHEN 5 THEN o_orderdate + to_minutes(o_orderkey % 24 * 60 + o_orderkey % 60)
        ELSE date_trunc('day', o_orderdate) END, '%Y-%m-%d %H:%M:%S') AS moment FROM orders"""),
    "tidy_spaces": (_tidy, f"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '{INVISIBLE}', '', 'g'),
        '{SPACES}', ' ', 'g')) AS t FROM documents) SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n FROM t"""),
    "match_text": (_match, rf"""WITH a AS (SELECT doc_id, regexp_replace(lower(regexp_replace(text, '^{SPACES}|{SPACES}$', '',
        'g')), '\.0$', '') AS t FROM documents),
        b AS (SELECT doc_id, regexp_replace(translate(t, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬', '01234567890123456789.,'),
              '[^\p{{L}}\p{{N}}_\s\x{{0B}}\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]',
              ' ', 'g') AS t FROM a),
        c AS (SELECT doc_id, list_filter(string_split_regex(t, '{SPACES}'), lambda w: w NOT IN ('', 'the', 'le')) AS w FROM b),
        d AS (SELECT doc_id, array_to_string(w, ' ') AS t FROM c)
        SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS n FROM d"""),
    "norm_text": (_norm, """SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS ref,
        regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '') AS balance, lower(c_name) AS name FROM customer"""),
    "placeholders": (_markers, """SELECT c_custkey AS customer_no, CASE c_custkey % 10 WHEN 0 THEN NULL
        WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN c_mktsegment[1] || lower(c_mktsegment[2:])
        WHEN 3 THEN '  ' || c_mktsegment || ' ' ELSE c_mktsegment END AS segment FROM customer"""),
    "replace_values": (_replaced, """SELECT c_custkey AS customer_no, CASE WHEN c_custkey % 10 = 0 THEN NULL
        WHEN c_mktsegment = 'BUILDING' THEN 'Construction' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Cars' ELSE
        CASE c_custkey % 10 WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN c_mktsegment[1] || lower(c_mktsegment[2:])
        WHEN 3 THEN '  ' || c_mktsegment || ' ' ELSE c_mktsegment END END AS segment FROM customer"""),
    "letter_case": (_cases, """WITH t AS (SELECT p_partkey, p_name || '-' || p_type AS t FROM part)
        SELECT p_partkey, upper(t) AS upper, lower(t) AS lower, array_to_string(list_transform(string_split(lower(t), ' '),
          lambda w: array_to_string(list_transform(string_split(w, '-'), lambda x: upper(x[1]) || x[2:]), '-')), ' ') AS title
        FROM t"""),
    "values_equal": (_equal, """SELECT c_custkey, c_custkey % 11 <> 0 AS balance_same,
        c_custkey % 3 = 0 OR c_custkey % 17 <> 0 AS segment_same, c_custkey % 13 <> 0 AS key_same FROM customer"""),
    "row_formula": (_formula, """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <> 1 THEN
        l_extendedprice * (1 - l_discount) / (l_quantity - 1) END AS value FROM lineitem"""),
    "keep_values": (_kept, """SELECT o_orderkey, o_orderpriority FROM orders
        WHERE o_orderpriority IN ('1-URGENT', '5-LOW')"""),
    "distinct_values": (_distinct, """SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment)
        WHEN c_custkey % 17 = 0 THEN 'OTHER' ELSE c_mktsegment END AS value FROM customer"""),
}
