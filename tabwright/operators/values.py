"""The value table: every distinct (column, value) of a table with its count and first row.

Repeats collapse before the shuffle, so a value that fills a third of the table costs no more than any
other, and each distinct value is parsed once. Quality checks, profiles, spelling variants and the
cleaning log are all aggregates over it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import plain_number
from ..functions.text import is_date, typed, value_text
from .rows import ROW, data_columns


def value_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(position, value, n, first_row); ``position`` counts the data columns, ``value`` is text or NULL.

    ``first_row`` is NULL for frames without row numbers.
    """
    names = data_columns(df)
    chosen = list(columns) if columns is not None else names
    entries = [F.struct(F.lit(names.index(c)).alias("position"), value_text(*typed(df, c)).alias("value"))
               for c in chosen]
    row = F.col(ROW).cast("bigint") if ROW in df.columns else F.lit(None).cast("bigint")
    return (df.select(F.inline(F.array(*entries)), row.alias("_r")).groupBy("position", "value")
            .agg(F.count(F.lit(1)).alias("n"), F.min("_r").alias("first_row")))


def positions(df: DataFrame, test) -> list[int]:
    """Positions of the columns whose type passes a test."""
    return [i for i, c in enumerate(data_columns(df)) if test(df.schema[c].dataType)]


def column_names(df: DataFrame) -> F.Column:
    """Expression: the column name for ``position``."""
    return F.element_at(F.array(*[F.lit(c) for c in data_columns(df)]), F.col("position") + 1)


def column_stats(df: DataFrame, values: DataFrame) -> DataFrame:
    """Profile of every column from its value table, one row per column."""
    dates = positions(df, is_date)
    bools = positions(df, lambda t: isinstance(t, T.BooleanType))
    dated = F.col("position").isin(dates) if dates else F.lit(False)
    text = F.col("value")
    if bools:
        text = F.when(F.col("position").isin(bools), (F.col("value") == "True").cast("int").cast("string")).otherwise(text)
    number = plain_number(text, T.StringType())
    v = values.withColumn("_x", F.when(~dated, number))
    n = F.col("n")
    out = v.groupBy("position").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), n).otherwise(0)).alias("empty"),
        F.count("value").alias("distinct"),
        F.sum(F.when(F.col("_x").isNotNull(), n).otherwise(0)).alias("_numbers"),
        F.sum(F.col("_x") * n).alias("sum"), F.min("_x").alias("min"), F.max("_x").alias("max"),
        F.min(F.when(dated, F.substring("value", 1, 10))).alias("earliest"),
        F.max(F.when(dated, F.substring("value", 1, 10))).alias("latest"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(-n, "value"))).alias("most_common"))
    filled = F.col("rows") - F.col("empty")
    numeric = (filled > 0) & (F.col("_numbers") >= 0.8 * filled) & ~dated
    return out.select(
        "position", column_names(df).alias("column"), "rows", "empty", "distinct", "earliest", "latest",
        F.when(numeric, F.col("sum")).alias("sum"),
        F.when(numeric, F.col("sum") / F.col("_numbers")).alias("average"),
        F.when(numeric, F.col("min")).alias("min"), F.when(numeric, F.col("max")).alias("max"),
        F.when(~numeric & ~dated, F.col("most_common")).alias("most_common")).orderBy("position").drop("position")
