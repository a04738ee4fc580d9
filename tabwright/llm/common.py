"""Shared pieces: words, tables in the shared folder, and frames that carry whole rows without name clashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word counts: the space and the control characters 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor reaches.

    Only a local session that has none gets a temporary one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-"))
    return context.getCheckpointDir()


_written: ContextVar[tuple[list[str], ...]] = ContextVar("tables_written", default=())


@contextmanager
def tables_written() -> Iterator[list[str]]:
    """The paths of the tables that this thread's `saved` writes meanwhile, so that a caller can delete them once it needs none."""
    paths: list[str] = []
    before = _written.set((*_written.get(), paths))
    try:
        yield paths
    finally:
        _written.reset(before)


def delete_tables(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def note_written(path: str) -> None:
    for paths in _written.get():
        paths.append(path)


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str = "table") -> DataFrame:
    """The frame as a written table of the shared folder: later steps see the same rows without repeating
    the work, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    note_written(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_below(df: DataFrame, megabytes: int = 16) -> DataFrame:
    """A broadcast hint if the frame, written beforehand, was measured to be smaller; else the frame as it is."""
    wide = [F.coalesce(F.octet_length(name(c)), F.lit(0)) if kind == "string" else F.lit(8) for c, kind in df.dtypes]
    size = df.agg(F.sum(sum(wide[1:], wide[0]))).head()[0] or 0
    return F.broadcast(df) if size < megabytes << 20 else df


def name(column: str) -> Column:
    """A column by its name, which may hold dots."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_rows(df: DataFrame) -> Column:
    """All columns of a frame as one struct, so that helper columns cannot clash with them."""
    return F.struct(*[name(c) for c in df.columns])


def unfold(df: DataFrame, row: str, columns: list[str], made: list[Column], names: list[str]) -> DataFrame:
    """The columns of a row struct and the made ones; an input column with the name of a made one gives way."""
    taken = {n.lower() for n in names}
    old = [F.col(row)[c].alias(c) for c in columns if c.lower() not in taken]
    return df.select(*old, *[m.alias(n) for m, n in zip(made, names)])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(name(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The array of words of a text."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")
