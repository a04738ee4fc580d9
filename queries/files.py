"""Writing, reading back and streaming."""

import uuid

from pyspark.sql import functions as F

from tabwright.functions.text import col
from tabwright.operators import check_quality
from tabwright.operators.stable import scratch_folder
from tabwright.sources import append_run_log, load_table, save_table, write_results
from tabwright.streaming import append_problems, clean_rows

from .inputs import customer_dirty, orders_dirty, read


def _folder(spark):
    return f"{scratch_folder(spark)}/{uuid.uuid4().hex}"


def _csv(spark, folder):
    path = save_table(orders_dirty(spark, folder).select("o_orderkey", "price_text", "date_text", "o_totalprice"),
                      _folder(spark) + "/orders_csv", "csv")
    made = load_table(spark, path, "csv", order_by=["o_orderkey"])
    return made.select("_row", "o_orderkey", "price_text", "o_totalprice")


def _json(spark, folder):
    path = _folder(spark) + "/customer_json"
    read(spark, folder, "customer").write.json(path)
    return load_table(spark, path, "json", order_by=["c_custkey"], multi_line=False).select(
        "_row", "c_custkey", "c_name", "c_acctbal")


def _parquet(spark, folder):
    """Two results written and read back whole, and the log of the run."""
    base = _folder(spark)
    paths = write_results({"Top orders": read(spark, folder, "orders"), "Lines": read(spark, folder, "lineitem")}, base)
    append_run_log(spark, base + "/log", {"task": "write", "status": "ok", "seconds": 1.5})
    lines = load_table(spark, paths["Lines"], "parquet", order_by=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.max("_row").alias("last_row"), F.sum("l_quantity").alias("amount"))
    orders = load_table(spark, paths["Top orders"], "parquet", order_by=["o_orderkey"]).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.max("_row").alias("last_row"), F.round(F.sum("o_totalprice"), 2).alias("amount"))
    log = spark.read.parquet(base + "/log").select(F.concat_ws(" ", "task", "status").alias("item"), F.lit(1).cast("bigint").alias("n"),
                                                   F.lit(0).cast("bigint").alias("last_row"), F.col("seconds").alias("amount"))
    return lines.withColumnRenamed("l_returnflag", "item").unionAll(orders.withColumnRenamed("o_orderstatus", "item")).unionAll(log)


def _stream_problems(spark, folder):
    base = _folder(spark)
    schema = read(spark, folder, "orders").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(folder)
    query = append_problems(stream, [{"column": "o_totalprice", "max": 450000}, {"column": "o_orderstatus", "allowed": ["F", "O"]}],
                            ["o_orderkey"], base + "/problems", base + "/state")
    query.awaitTermination()
    return spark.read.parquet(base + "/problems").select("row_o_orderkey", F.col("column").alias("column_name"), "value", "problem")


def _stream_clean(spark, folder):
    """The row-local steps are the same expressions on a stream and on a table."""
    made = clean_rows(customer_dirty(spark, folder), {"to_number": ["balance"], "fix_case": {"segment": "upper"}})
    return made.select("customer_no", "segment", "balance")


def _second_header(spark, folder):
    """A file whose header names one column twice, read back, and what the quality check says of it."""
    c = read(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("nation "))
    path = _folder(spark) + "/twice_csv"
    c.write.option("header", True).csv(path)
    made = load_table(spark, path, "csv", order_by=["c_custkey"])
    issues = check_quality(made).issues.where("code = 'second_header'")
    cells = made.select(F.lit("cells").alias("item"), F.concat_ws(" ", "c_custkey", "nation", col("nation.1")).alias("value"))
    return cells.unionAll(issues.select(F.lit("issue"), F.concat_ws(" ", "code", "column")))


def _tsv_quoted(spark, folder):
    """Tab-separated files with line breaks and inch marks in their cells."""
    part = read(spark, folder, "part")
    name = F.when(F.col("p_partkey") % 50 == 7, F.concat("p_name", F.lit("\n"), "p_type")).when(
        F.col("p_partkey") % 50 == 8, F.concat("p_name", F.lit(' 12" wide'))).otherwise(F.col("p_name"))
    path = _folder(spark) + "/parts_tsv"
    part.select("p_partkey", name.alias("name"), "p_size").repartition(4, "p_size").write.option("header", True).option(
        "sep", "\t").option("escape", '"').csv(path)
    return load_table(spark, path, "tsv", order_by=["p_partkey"]).select("p_partkey", "name", "p_size")


QUERIES = {
    "csv_round_trip": (_csv, """SELECT o_orderkey AS _row, o_orderkey, o_totalprice, CASE o_orderkey % 6
        WHEN 0 THEN printf('%.2f', o_totalprice) WHEN 1 THEN printf('%,.2f', o_totalprice)
        WHEN 2 THEN 'IQD ' || printf('%,.2f', o_totalprice) WHEN 3 THEN '(' || printf('%.2f', o_totalprice) || ')'
        WHEN 4 THEN printf('%.2f', o_totalprice) || '%'
        ELSE translate(printf('%.2f', o_totalprice), '0123456789.', '٠١٢٣٤٥٦٧٨٩٫') END AS price_text FROM orders"""),
    "json_round_trip": (_json, "SELECT c_custkey AS _row, c_custkey, c_name, c_acctbal FROM customer"),
    "results_round_trip": (_parquet, """WITH l AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS r FROM lineitem),
        o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders)
        SELECT l_returnflag AS item, count(*) AS n, max(r) AS last_row, sum(l_quantity)::DOUBLE AS amount FROM l GROUP BY 1
        UNION ALL SELECT o_orderstatus, count(*), max(r), round(sum(o_totalprice), 2) FROM o GROUP BY 1
        UNION ALL SELECT 'write ok', 1, 0, 1.5"""),
    "stream_problems": (_stream_problems, """SELECT o_orderkey AS row_o_orderkey, 'o_totalprice' AS column_name,
        CAST(o_totalprice AS VARCHAR) AS value, 'Must be at most 450000' AS problem FROM orders WHERE o_totalprice > 450000
        UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus, 'Not an allowed value (F, O)' FROM orders
        WHERE o_orderstatus NOT IN ('F', 'O')"""),
    "second_header": (_second_header, """SELECT 'cells' AS item, concat_ws(' ', c_custkey, c_nationkey, c_mktsegment) AS value FROM customer
        UNION ALL SELECT 'issue', 'second_header nation.1'"""),
    "tsv_quoted_breaks": (_tsv_quoted, """SELECT p_partkey, CASE p_partkey % 50 WHEN 7 THEN p_name || chr(10) || p_type
        WHEN 8 THEN p_name || ' 12" wide' ELSE p_name END AS name, p_size::BIGINT AS p_size FROM part"""),
    "clean_rows": (_stream_clean, """SELECT c_custkey AS customer_no, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS segment,
        c_acctbal AS balance FROM customer"""),
}
