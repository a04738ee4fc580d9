"""Reading the given tables, and dirty copies of them built by arithmetic on their keys.

A dirty copy holds every row of its table; only the way its values are written changes.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_row(df: DataFrame, key: str) -> DataFrame:
    """These tables are numbered from 0 by their key, so the key is the row number."""
    return df.withColumn("_row", F.col(key).cast("bigint"))


def orders_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Prices as text in six forms, dates as text in four."""
    o = read(spark, folder, "orders")
    plain, grouped = F.format_string("%.2f", "o_totalprice"), F.format_number("o_totalprice", 2)
    form, date_form = F.col("o_orderkey") % 6, F.col("o_orderkey") % 4
    price = (F.when(form == 0, plain).when(form == 1, grouped).when(form == 2, F.concat(F.lit("IQD "), grouped))
             .when(form == 3, F.concat(F.lit("("), plain, F.lit(")"))).when(form == 4, F.concat(plain, F.lit("%")))
             .otherwise(F.translate(plain, "0123456789.", "٠١٢٣٤٥٦٧٨٩٫")))
    day = F.col("o_orderdate").cast("date")
    iso = day.cast("string")
    month = F.element_at(F.array(*[F.lit(m) for m in (
        "January", "Feb", "Mar", "April", "May", "Jun", "July", "Aug", "September", "Oct", "Nov", "December")]), F.month(day))
    date = (F.when(date_form == 0, iso)
            .when(date_form == 1, F.concat_ws("/", F.lpad(F.day(day).cast("string"), 2, "0"),
                                              F.lpad(F.month(day).cast("string"), 2, "0"), F.year(day).cast("string")))
            .when(date_form == 2, F.concat_ws(" ", F.day(day).cast("string"), month, F.year(day).cast("string")))
            .otherwise(F.date_diff(day, F.lit("1899-12-30").cast("date")).cast("string")))
    return with_row(o, "o_orderkey").select("_row", "o_orderkey", price.alias("price_text"), date.alias("date_text"),
                                            "o_totalprice", "o_orderdate")


def customer_restated(spark: SparkSession, folder: str) -> DataFrame:
    """The customers as another system might hold them: keys as text or missing, some balances moved by
    1, segments in other letters."""
    c, k = read(spark, folder, "customer"), F.col("c_custkey")
    ref = F.when(k % 13 != 0, F.concat(F.lit("  "), k.cast("string"), F.lit(".0 ")))
    balance = F.col("c_acctbal") + F.when(k % 11 == 0, 1.0).otherwise(0.0)
    segment = F.when(k % 3 == 0, F.lower("c_mktsegment")).when(k % 17 == 0, "OTHER").otherwise(F.col("c_mktsegment"))
    return c.select(k.alias("_row"), ref.alias("ref"), balance.alias("balance"), segment.alias("segment"))


CUSTOMER_RESTATED = """
restated AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 13 <> 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS ref,
    c_acctbal + CASE WHEN c_custkey % 11 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS balance,
    CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 17 = 0 THEN 'OTHER'
         ELSE c_mktsegment END AS segment FROM customer)"""


def customer_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Segments in lower case, title case, padded or as a placeholder; balances as text; the name as is."""
    c, k = read(spark, folder, "customer"), F.col("c_custkey")
    s = F.col("c_mktsegment")
    segment = (F.when(k % 10 == 0, "n/a").when(k % 10 == 1, F.lower(s)).when(k % 10 == 2, F.initcap(s))
               .when(k % 10 == 3, F.concat(F.lit("  "), s, F.lit(" "))).otherwise(s))
    balance = F.format_number("c_acctbal", 2)
    return c.select(k.alias("_row"), F.col("c_custkey").alias("customer_no"), F.col("c_name").alias("name"),
                    segment.alias("segment"), balance.alias("balance"), F.col("c_nationkey").alias("nation"))


def parts_named(spark: SparkSession, folder: str) -> DataFrame:
    p = read(spark, folder, "part")
    return p.select(F.col("p_partkey").alias("_row"), "p_name", "p_brand", "p_size", "p_retailprice")


def parts_mistyped(spark: SparkSession, folder: str) -> DataFrame:
    """Part names with one letter left out, at a place that depends on the key; some under another name."""
    p = read(spark, folder, "part")
    gap = (F.col("p_partkey") % F.length("p_name") + 1).cast("int")
    name = F.concat(F.expr("substring(p_name, 1, cast(p_partkey % length(p_name) as int))"),
                    F.substring("p_name", gap + 1, F.length("p_name")))
    name = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("unlisted "), "p_type")).otherwise(name)
    return p.select(F.col("p_partkey").alias("_row"), name.alias("item"), "p_brand", "p_size",
                    (F.col("p_retailprice") + F.when(F.col("p_partkey") % 5 == 0, 1.0).otherwise(0.0)).alias("price"))
