"""Row identity, previews, value filters and looking up one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.text import col, is_date, norm_text, typed, value_text
from .stable import broadcast_if_small, stable

ROW = "_row"


def with_row_number(df: DataFrame, order_by: Sequence[str | Column] | None = None, name: str = ROW) -> DataFrame:
    """Add a dense 0-based row number.

    The frame is range-sorted by ``order_by``, or kept in the order of its files (by path, then place in the file;
    frames without files keep the order of their partitions), and written to the checkpoint folder. The rows that a task
    read from one piece of a file lie side by side, so a row's number is its place in the piece plus the rows of earlier
    pieces. No task sees more than its own rows.
    """
    if order_by:
        placed = df.orderBy(*order_by).withColumns({"_file": F.lit(""), "_block": F.lit(0).cast("bigint")})
    else:
        placed = df.withColumns({"_file": F.input_file_name(), "_block": F.input_file_block_start()})
    placed = stable(placed.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    piece = ["_file", "_block", "_part"]
    sizes = placed.groupBy(*piece).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    # one row per piece of a file, whatever the number of rows
    before = F.sum("_n").over(W.orderBy(*piece).rowsBetween(W.unboundedPreceding, -1))
    starts = stable(sizes.select(*piece, "_low", F.coalesce(before, F.lit(0)).alias("_start")))
    numbered = placed.join(broadcast_if_small(starts), piece)
    position = F.col("_start") + F.col("_at") - F.col("_low")
    return numbered.select(*[col(c) for c in df.columns if c != name], position.alias(name))


def ensure_rows(df: DataFrame) -> DataFrame:
    return df if ROW in df.columns else with_row_number(df)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]


def file_row() -> Column:
    """Row number as seen in a file whose first line is the header."""
    return (F.col(ROW) + 2).alias("row_in_file")


def preview(df: DataFrame, rows: int = 100) -> DataFrame:
    """The first rows of a table."""
    return df.orderBy(ROW).limit(rows)


def keep_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose value, shown as text, is in a list."""
    return df.filter(value_text(*typed(df, column)).isin([str(v) for v in values]))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-empty values of a column, as text."""
    text = value_text(*typed(df, column)).alias("value")
    return df.select(text).where("value is not null").distinct().orderBy("value")


def find_row(df: DataFrame, by: str, value) -> DataFrame:
    """At most one row: the first hit, with ``hits`` telling how many rows matched.

    ``by`` is ``row_number`` (0-based) or a column; text matches without regard to case, outer spaces or
    a trailing ``.0``, dates match by calendar day.
    """
    if by.lower().replace(" ", "_") == "row_number":
        hit = F.col(ROW) == int(value)
    else:
        c, dtype = typed(df, by)
        if is_date(dtype):
            hit = c.cast("date") == parse_date(F.lit(str(value)), df.select(F.lit("")).schema[0].dataType).cast("date")
        else:
            hit = norm_text(c, dtype, True) == str(value).strip().lower().removesuffix(".0")
    first = F.min_by(F.struct(*[col(c) for c in df.columns]), F.col(ROW)).alias("_first")
    return (df.filter(hit).agg(first, F.count(F.lit(1)).alias("hits")).where("hits > 0")
            .select("_first.*", "hits"))
