"""The corpus pipeline: from documents to packed training sequences, each stage a written table of the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabwright.llm import bloom_dedup, bt_quality, mixing, packing, simhash
from tabwright.llm.common import delete_tables, new_path, note_written, read, tables_written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _written(work: Stage) -> Stage:
    """A stage whose result is a table of its own; the tables that it worked with are deleted before it returns.

    So results stay readable whatever stage is called next, and how often.
    """
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        paths: list[str] = []
        try:
            with tables_written() as paths:
                made = work(spark, docs, sf_dir)
                path = new_path(spark, f"stage-{work.__name__}")
                made.write.option("compression", "zstd").parquet(path)
        finally:
            delete_tables(spark, paths)
        note_written(path)
        return spark.read.schema(made.schema).parquet(path)

    stage.__name__, stage.__doc__ = work.__name__, work.__doc__
    return stage


@_written
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned ranking rejects go.

    Of all stages: a null text counts as empty, rows without a key are rows like others, further columns stay, and an empty
    table gives an empty table."""
    return bt_quality.keep_good(docs, read(spark, sf_dir, "labels"))


@_written
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that agree but for white space, one stays."""
    return bloom_dedup.drop_duplicates(docs)


@_written
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 or more of their 5-word shingles, one stays."""
    return simhash.keep_unlike(docs)


@_written
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and their places in sequences, read from the tables that packing has written."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: A learned ranking, fingerprints and tokens are beyond SQL; the tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the tables of all but the last are deleted once the next has read them."""
    docs, earlier = read(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        with tables_written() as paths:
            docs = stage(spark, docs, sf_dir)
        delete_tables(spark, earlier)
        earlier = paths
    return docs
