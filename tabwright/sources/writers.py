"""Writing results."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# The columns of the run log.
RUN_LOG = ["started", "profile", "task", "input_a", "input_b", "output", "status", "seconds", "message"]


def resolve_output(template: str, profile: str = "report", now: dt.datetime | None = None) -> str:
    """Fill ``{date} {month} {time} {profile}`` in an output path."""
    now = now or dt.datetime.now()
    return template.format(date=now.strftime("%Y-%m-%d"), month=now.strftime("%Y-%m"), time=now.strftime("%H%M"),
                           profile=profile)


def save_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write one table as a folder of Parquet or CSV files; returns its path."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("encoding", "UTF-8").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError('fmt is "parquet" or "csv"')
    return path


def cleaned_path(source: str, folder: str) -> str:
    """Where the cleaned copy of a source goes: ``<folder>/<name>_cleaned``."""
    name = re.sub(r"\.[^.]*$", "", source.rstrip("/").rsplit("/", 1)[-1])
    return f"{folder.rstrip('/')}/{name}_cleaned"


def _apart(names: list[str]) -> list[str]:
    """The names with a number behind those that are taken already, whatever their case."""
    out: list[str] = []
    for n in names:
        made, i = n, 2
        while made.lower() in (o.lower() for o in out):
            made, i = f"{n}_{i}", i + 1
        out.append(made)
    return out


def write_results(results: Mapping[str, DataFrame], base: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every named result to its own folder under ``base``, whole; returns the paths by name.

    Names that become equal once unsafe characters are replaced get a number: ``a b`` and ``a_b`` go to ``a_b``
    and ``a_b_2``.
    """
    out = {}
    folders = _apart([re.sub(r"[\[\]:*?/\\ ]", "_", name) or "Sheet" for name in results])
    for (name, df), safe in zip(results.items(), folders):
        if fmt == "parquet":    # column names may hold characters that some readers refuse
            df = df.toDF(*_apart([re.sub(r"[ ,;{}()\n\t=]", "_", c) for c in df.columns]))
        out[name] = save_table(df, f"{base.rstrip('/')}/{safe}", fmt)
    return out


def append_run_log(spark: SparkSession, path: str, entry: Mapping) -> None:
    """Append one run (started, profile, task, inputs, output, status, seconds, message) to a Parquet table."""
    row = tuple(None if entry.get(c) is None else float(entry[c]) if c == "seconds" else str(entry[c]) for c in RUN_LOG)
    schema = ", ".join(f"{c} {'double' if c == 'seconds' else 'string'}" for c in RUN_LOG)
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)
