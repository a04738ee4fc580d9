"""Fixing a frame in reliable storage, and broadcasting only what has been measured."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 16 << 20


def scratch_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder (``spark.checkpoint.dir``), which every executor can reach.

    Only a session on one machine (master ``local``) that has none gets a temporary folder.
    """
    context = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if context.getCheckpointDir() is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tabwright-"))
    return context.getCheckpointDir().rstrip("/")


def _tables(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def stable(df: DataFrame) -> DataFrame:
    """Write the frame as a compressed columnar table below the checkpoint folder and read it back: later steps
    see the same rows, do not repeat the work, read only the columns they need, and survive lost executors."""
    names = [f.name.lower() for f in df.schema]
    if len(set(names)) < len(names) or any(isinstance(f.dataType, (T.NullType, T.CalendarIntervalType)) for f in df.schema):
        # what a table cannot hold
        if df.sparkSession.sparkContext.getCheckpointDir() is None:
            df.sparkSession.sparkContext.setCheckpointDir(scratch_folder(df.sparkSession))
        return df.checkpoint(eager=True)
    path = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that this session's operators have written; call it when their results are no longer needed."""
    jvm, path = spark.sparkContext._jvm, _tables(spark)
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint when the frame's values were measured to be small; otherwise Spark shuffles the join."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) + 8 if t in ("string", "binary") else F.lit(8) for c, t in df.dtypes]
    total = df.agg(F.sum(sum(sizes[1:], sizes[0]).cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if total <= most else df
