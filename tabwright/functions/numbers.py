"""Reading numbers out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import constants as C
from .text import is_number, is_text, let, strip, western_digits

_BODY = {".": r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?",
         ",": r"(?:[0-9]{1,3}(?:\.[0-9]{3})+|[0-9]+)(?:,[0-9]+)?"}


def parse_number(c: Column, dtype: T.DataType, decimal: str = ".") -> Column:
    """The number in a cell as double, NULL when there is none.

    Reads ``1,250``, ``$1,250.50``, ``IQD 15,000``, Arabic digits, ``(500)`` and ``500-`` (negative)
    and ``15%`` (= 15). A non-NULL cell with a NULL result could not be read.
    """
    if decimal not in _BODY:
        raise ValueError('decimal must be "." or ","')
    if is_number(dtype) or isinstance(dtype, T.BooleanType):
        return c.cast("double")
    if not is_text(dtype):
        return F.lit(None).cast("double")
    # most cells are bare digits: a short test settles them, the rest takes the long way
    bare = F.when(c.rlike(r"^[0-9]{1,15}\z" if decimal == "," else r"^[0-9]{1,15}(?:\.[0-9]+)?\z"),
                  c.try_cast("double"))
    known = F.when(c.rlike(r"[^0-9.,()%+-]"), F.regexp_replace(western_digits(c), C.CURRENCY_OR_SPACE, "")).otherwise(c)
    return F.coalesce(bare, let(known, lambda t: _signed_number(t, decimal)))


def _signed_number(t: Column, decimal: str) -> Column:
    """The number in a text without currency and spaces."""
    digits = F.regexp_replace(t, r"[^0-9.,]", "")
    if decimal == ".":
        digits = F.replace(digits, F.lit(","), F.lit(""))
    else:
        digits = F.translate(digits, ",.", ".")
    value = digits.try_cast("double")
    negative = t.rlike(r"^\+?\(|^-|-%?\z")
    readable = t.rlike(r"^[+-]?\(?[+-]?" + _BODY[decimal] + r"\)?-?%?\z")
    return F.when(readable, F.when(negative, -value).otherwise(value))


def plain_number(c: Column, dtype: T.DataType) -> Column:
    """Strict reading: ``12``, ``-1.5``, ``1e3``; ``"1,250"`` is not a plain number."""
    if is_number(dtype) or isinstance(dtype, T.BooleanType):
        return c.cast("double")
    if not is_text(dtype):
        return F.lit(None).cast("double")
    t = strip(c)
    return F.when(t.rlike(C.PLAIN_NUMBER.replace("$", r"\z")), t.try_cast("double"))


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def exact_sum(c: Column) -> Column:
    """The sum of doubles, rounded once: the same whatever the order of the rows. NULL without values.

    Adding doubles one by one loses cents over millions of rows. Multiples of 2^-30 are added as decimals, and what is below them
    apart; only values from 2^33 on are added as doubles.
    """
    c = c.cast("double")
    scaled = F.when(F.abs(c) < 2.0 ** 33, c * 2.0 ** 30)
    whole = F.sum(F.floor(scaled).cast("decimal(19,0)")).cast("double")
    rest, large = F.sum(scaled - F.floor(scaled)), F.sum(F.when(scaled.isNull(), c))
    zero = F.lit(0.0)
    return F.when(F.count(c) > 0, F.coalesce((whole + rest) / 2.0 ** 30, zero) + F.coalesce(large, zero))
