"""The row-local operators on streams.

Cleaning and rules that need only the row itself work on a streaming frame as they are. Which columns hold
numbers or dates must be given, since a stream has no whole to look at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import parse_date
from ..functions.numbers import parse_number
from ..functions.text import col, is_text, typed
from ..operators.clean import _stages, settings
from ..operators.rules import row_rule_problems


def clean_rows(df: DataFrame, cfg: Mapping | None = None) -> DataFrame:
    """Placeholders, spaces, replacements, letter case, and the listed date and number columns."""
    cfg = settings({"to_date": [], "to_number": [], **(cfg or {})}, df.columns)
    stages = {c: _stages(col(c), c, cfg) for c in df.columns if is_text(df.schema[c].dataType)}
    out = df.select(*[stages[c][-1][1].alias(c) if stages.get(c) else col(c) for c in df.columns])
    made = {c: parse_date(*typed(out, c), cfg["day_first"]) for c in cfg["to_date"]}
    made.update({c: parse_number(*typed(out, c), cfg["decimal"]) for c in cfg["to_number"]})
    return out.select(*[made.get(c, col(c)).alias(c) for c in df.columns])


def rule_problems(df: DataFrame, rules: Sequence[Mapping], row_id: Sequence[str], as_of=None,
                  day_first: bool = True) -> DataFrame:
    """Broken rules, each with the columns that identify its row. ``unique`` needs the whole table."""
    if any(r.get("unique") for r in rules):
        raise ValueError("a unique rule needs the whole table; use evaluate_rules on each batch or table")
    judged, problems = row_rule_problems(df, rules, as_of, day_first)
    return judged.select(*[col(c).alias(f"row_{c}") for c in row_id], F.inline(problems)).where("problem is not null")


def append_problems(stream: DataFrame, rules: Sequence[Mapping], row_id: Sequence[str], path: str, checkpoint: str,
                    as_of=None) -> StreamingQuery:
    """Write the problems of a stream to a folder per micro-batch; a repeated batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        rule_problems(batch, rules, row_id, as_of).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
