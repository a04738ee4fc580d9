"""What a column really holds, judged from its value table."""

from __future__ import annotations

import re
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions.dates import parse_date
from ..functions.numbers import parse_number
from ..functions.text import is_date, is_number, is_text, strip, western_digits
from .rows import data_columns

TEXT = T.StringType()


class Facts(NamedTuple):
    """What the driver learns about one column: a fixed number of figures, whatever the table's size."""
    kind: str
    other_kind: str          # the kind if the other decimal mark were used
    whole: bool              # every number read is whole and exact
    filled: int
    texts: int
    numbers: int
    plain: int


def per_column(values: list, type_name: str) -> Column:
    """The entry for this row's ``position`` from one value per column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]).cast(f"array<{type_name}>"), F.col("position") + 1)


def looks_like_date(c: Column) -> Column:
    return c.rlike(C.DATE_LIKE)


def _whole(x: Column) -> Column:
    """Aggregate: every number read is whole and exact."""
    return F.coalesce(F.bool_and(F.when(x.isNotNull(), (x % 1 == 0) & (F.abs(x) < 2.0 ** 53))), F.lit(False))


def whole_columns(values: DataFrame, positions: list[int], decimal: str = ".") -> set[int]:
    """Those of the columns whose numbers are all whole and exact, as `column_facts` has it, without its other tests."""
    read = values.where(F.col("position").isin(positions) & F.col("value").isNotNull()).select(
        "position", parse_number(F.col("value"), TEXT, decimal).alias("x"))
    return {r["position"] for r in read.groupBy("position").agg(_whole(F.col("x")).alias("whole")).collect() if r["whole"]}


def column_facts(df: DataFrame, values: DataFrame, decimal: str = ".", day_first: bool = True) -> list[Facts]:
    """One aggregate over (position, value, n) rows of non-missing values, one result row per column."""
    types = [df.schema[c].dataType for c in data_columns(df)]
    physical = ["text" if is_text(t) else "number" if is_number(t) else "date" if is_date(t)
                else "yesno" if isinstance(t, T.BooleanType) else "text" for t in types]
    v, n = F.col("value"), F.col("n")
    t = strip(western_digits(v))
    number, swapped = parse_number(v, TEXT, decimal), parse_number(v, TEXT, "," if decimal == "." else ".")

    def count(test: Column) -> Column:
        return F.sum(F.when(test, n).otherwise(0))

    # only columns held as text are judged by what their values look like
    judged = per_column([k == "text" for k in physical], "boolean")

    def look(test: Column) -> Column:
        return F.when(judged, test)

    # each test is evaluated once per distinct value, then weighted
    tests = values.where("value is not null").select(
        "position", "n", number.alias("x"), look(swapped).alias("y"), look(t.rlike(r"^0[0-9]+\z")).alias("zero"),
        look(t.rlike(r"^[0-9]{16,}\z")).alias("long"), look(looks_like_date(t)).alias("dated"),
        look(F.lower(t).isin(C.YES_NO)).alias("yn"), strip(v).rlike(C.PLAIN_NUMBER).alias("plain"),
        look(parse_date(v, TEXT, day_first).isNotNull()).alias("date"))
    rows = tests.groupBy("position").agg(
        F.sum("n").alias("filled"), count(F.col("zero")).alias("zero"), count(F.col("long")).alias("long"),
        count(F.col("dated")).alias("dated"), count(~F.col("date")).alias("bad_date"),
        count(F.col("x").isNull()).alias("bad_number"), count(F.col("y").isNull()).alias("bad_swapped"),
        count(F.col("yn")).alias("yn"), count(F.col("plain")).alias("plain"),
        _whole(F.col("x")).alias("whole")).collect()
    found = {r["position"]: r for r in rows}
    out = []
    for i, kind in enumerate(physical):
        r = found.get(i)
        if r is None:
            out.append(Facts("empty", "empty", False, 0, 0, 0, 0))
            continue
        kinds = [kind if kind != "text" else _text_kind(r, bad) for bad in ("bad_number", "bad_swapped")]
        out.append(Facts(*kinds, r["whole"], r["filled"], r["filled"] if is_text(types[i]) else 0,
                         r["filled"] - r["bad_number"], r["plain"]))
    return out


def _text_kind(r, bad_number: str) -> str:
    n = r["filled"]
    if r["zero"] >= C.CODE_SHARE * n or r["long"] >= C.CODE_SHARE * n:
        return "code"
    if r["dated"] >= C.DATE_SHARE * n and r["bad_date"] <= C.FAILED_SHARE * n:
        return "date_text"
    if r[bad_number] <= C.FAILED_SHARE * n:
        return "number_text"
    return "yesno_text" if r["yn"] >= C.YES_NO_SHARE * n else "text"


def id_like(name: str) -> bool:
    return re.search(C.ID_NAME, name) is not None
