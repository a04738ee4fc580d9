"""When two cells count as equal, and by how much numbers differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import plain_number
from .text import is_date, norm_text

Cell = tuple[Column, T.DataType]


def values_equal(a: Cell, b: Cell, tolerance: float = 0.0, ignore_case: bool = False) -> Column:
    """Two missing cells are equal. Two numbers are equal within the tolerance, and that verdict is
    final. One missing cell is a difference. Everything else compares as normalised text."""
    (ca, ta), (cb, tb) = a, b
    same_text = norm_text(ca, ta, ignore_case) == norm_text(cb, tb, ignore_case)
    if is_date(ta) and is_date(tb):
        verdict = ca.cast("timestamp_ntz") == cb.cast("timestamp_ntz")
    elif is_date(ta) or is_date(tb):
        verdict = same_text
    else:
        na, nb = plain_number(ca, ta), plain_number(cb, tb)
        verdict = F.when(na.isNotNull() & nb.isNotNull(), F.abs(na - nb) <= F.lit(float(tolerance))).otherwise(
            same_text)
    return (F.when(ca.isNull() & cb.isNull(), F.lit(True))
            .when(ca.isNull() | cb.isNull(), F.lit(False))
            .otherwise(verdict))


def difference(a: Cell, b: Cell) -> Column:
    """b - a for plain numbers, NULL otherwise."""
    if is_date(a[1]) or is_date(b[1]):
        return F.lit(None).cast("double")
    return plain_number(*b) - plain_number(*a)
