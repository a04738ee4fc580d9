"""Column expressions: text, numbers, dates, equality, formulas, similarity."""

from .dates import parse_date, period_label, period_start
from .equality import difference, values_equal
from .formula import formula
from .numbers import parse_number, plain_number
from .similarity import similarity
from .text import (letter_case, marker_to_null, match_text, match_text_of, norm_text, replace_values,
                   tidy_spaces, value_text, western_digits)

__all__ = ["parse_date", "period_label", "period_start", "difference", "values_equal", "formula",
           "parse_number", "plain_number", "similarity", "letter_case", "marker_to_null", "match_text",
           "match_text_of", "norm_text", "replace_values", "tidy_spaces", "value_text", "western_digits"]
