"""Loading tables from files."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import PLAIN_NUMBER
from ..functions.text import col, is_text, strip
from ..operators.rows import with_row_number

# Separators tried for delimited text, best count in the header wins.
SEPARATORS = [",", ";", "|", "\t"]

# Cell texts of a delimited file that are read as missing.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
           "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

ARABIC_WINDOWS = "cp1256"
# its upper half as ISO-8859-1 shows it and as it should read; Spark decodes only the former by itself
_HIGH = [(chr(b), bytes([b]).decode("cp1256")) for b in range(128, 256)]
_SEEN, _MEANT = ("".join(x) for x in zip(*_HIGH))

# File endings and how they are read.
FORMATS = {"csv": "text", "txt": "text", "tsv": "text", "json": "json", "parquet": "parquet"}


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator that occurs most often, outside quotes, in the first line with text."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    bare = "" if first is None else "".join(first[0].split('"')[::2])
    return max(SEPARATORS, key=bare.count)


def profile_text(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """Encoding, and the files that may have line breaks inside quotes, from one distributed pass.

    UTF-8 when every line is valid UTF-8, else Arabic Windows. A cell that goes on over the line's end leaves its line an odd
    number of quotes, one of them at the start of a cell; a quote amid a cell alone, as an inch mark, is none.
    """
    odd = (F.regexp_count("value", F.lit('"')) % 2 == 1) & F.col("value").rlike(r'(?:^|[,;|\t])"|"(?:\r?$|[,;|\t])')
    seen = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).groupBy("file").agg(
        F.bool_or(~F.is_valid_utf8("value")).alias("broken"), F.bool_or(odd).alias("odd"))
    told = seen.where("broken or odd").collect()            # one row per file that stands out
    return ARABIC_WINDOWS if any(r["broken"] for r in told) else "UTF-8", sorted(r["file"] for r in told if r["odd"])


def find_encoding(spark: SparkSession, path: str) -> str:
    return profile_text(spark, path)[0]


def header_names(cells: Sequence[str], read_as: Sequence[str]) -> list[str]:
    """Column names of a header: a name that was there before gets ``.1``, ``.2`` and so on; an empty cell keeps the name it was read as."""
    met: set[str] = set()
    names = []
    for cell, given in zip(cells, read_as):
        name, k = cell or given, 0
        while name.lower() in met:
            k += 1
            name = f"{cell or given}.{k}"
        met.add(name.lower())
        names.append(name)
    return names


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
                   multi_line: bool | None = None, infer: bool = True) -> DataFrame:
    """CSV, TXT or TSV as text first, so codes keep their leading zeros; then number columns are typed.

    ``multi_line`` allows line breaks inside quotes, at the price of one task per file; None: in the files where they may
    occur, while the others are split. Columns of one name are told apart by ``.1``.
    """
    several: list[str] = []
    if encoding is None or multi_line is None:
        found, several = profile_text(spark, path)
        encoding = encoding or found
    sep = sep or sniff_separator(spark, path)
    arabic = encoding == ARABIC_WINDOWS
    options = dict(inferSchema=False, sep=sep, quote='"', escape='"', encoding="ISO-8859-1" if arabic else encoding)
    whole = bool(several) if multi_line is None else multi_line
    df = spark.read.csv(path, header=True, multiLine=whole, **options)
    if multi_line is None and several:
        plain = spark.read.schema(df.schema).csv(path, header=True, **options).where(~F.col("_metadata.file_path").isin(several))
        df = plain.unionAll(spark.read.schema(df.schema).csv(path, header=True, multiLine=True, **options).where(
            F.col("_metadata.file_path").isin(several)))
    head = spark.read.csv(path, header=False, multiLine=whole, **options).first()
    names = header_names(head or df.columns, df.columns)
    if arabic:
        names = [c.translate(str.maketrans(_SEEN, _MEANT)) for c in names]
        df = df.select(*[F.translate(col(c), _SEEN, _MEANT).alias(c) for c in df.columns])
    df = df.toDF(*[c.lstrip("﻿") for c in names])
    df = df.select(*[F.when(~col(c).isin(MISSING), col(c)).alias(c) for c in df.columns])
    return infer_numbers(df) if infer else df


def infer_numbers(df: DataFrame) -> DataFrame:
    """Text columns whose every value is a plain number without a leading zero become numbers: whole ones
    below 2^53 BIGINT, others DOUBLE. One aggregate over all columns."""
    names = [f.name for f in df.schema if is_text(f.dataType)]
    if not names:
        return df
    tests = []
    for i, c in enumerate(names):
        t = strip(col(c))
        x = t.try_cast("double")
        tests += [F.bool_and(t.rlike(PLAIN_NUMBER.replace("$", r"\z"))).alias(f"n{i}"),
                  F.bool_or(t.rlike(r"^[+-]?0[0-9]")).alias(f"z{i}"),
                  F.bool_and((x % 1 == 0) & (F.abs(x) < 2.0 ** 53)).alias(f"w{i}")]
    seen = df.agg(*tests).first()
    kinds = {c: ("bigint" if seen[f"w{i}"] else "double") for i, c in enumerate(names)
             if seen[f"n{i}"] and not seen[f"z{i}"]}
    return df.select(*[strip(col(c)).try_cast("double").cast(kinds[c]).alias(c) if c in kinds else col(c)
                       for c in df.columns])


def tidy_table(df: DataFrame, order_by=None) -> DataFrame:
    """Trim column names, drop rows and columns without any value, then number the rows (``_row``)."""
    df = df.toDF(*header_names([c.strip() for c in df.columns], df.columns))
    some = [col(c).isNotNull() & ~F.isnan(col(c)) if t in ("double", "float") else col(c).isNotNull() for c, t in df.dtypes]
    df = df.where(reduce(Column.__or__, some, F.lit(False)))
    filled = df.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    keep = [c for i, c in enumerate(df.columns) if filled[f"c{i}"]]
    return with_row_number(df.select(*[col(c) for c in keep]), order_by)


def load_table(spark: SparkSession, path: str, fmt: str | None = None, order_by=None, **options) -> DataFrame:
    """Load one table by file ending (csv, txt, tsv, json, parquet) and tidy it."""
    if not str(path).strip():
        raise ValueError("the path is empty")
    ending = (fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if ending not in FORMATS:
        raise ValueError(f"unsupported file type {ending!r}; supported: {list(FORMATS)}")
    if FORMATS[ending] == "text":
        if ending == "tsv":
            options.setdefault("sep", "\t")
        df = read_delimited(spark, path, **options)
    elif ending == "json":
        df = spark.read.json(path, multiLine=options.get("multi_line", True))
    else:
        df = spark.read.parquet(path)
    return tidy_table(df, order_by)


def load_tables(spark: SparkSession, paths: Mapping[str, str], **options) -> dict[str, DataFrame]:
    """Load several named tables and register each as a temporary view. Tables without rows are left out."""
    out = {}
    for name, path in paths.items():
        df = load_table(spark, path, **options)
        if not df.isEmpty():
            df.createOrReplaceTempView(name)
            out[name] = df
    return out
