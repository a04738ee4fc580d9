"""Operators on whole tables."""

from .clean import clean_table, cleaning_summary, drop_duplicate_rows, merge_rows, unify_spelling
from .compare import (column_profile, compare_columns, compare_rows, compare_schema, compare_tables, exact_compare,
                      profile_columns, rowwise_compare, value_overlap)
from .fuzzy import fuzzy_compare
from .pivot import pivot_table
from .quality import check_quality, duplicate_rows, similar_values
from .quantile import quantiles
from .rows import distinct_values, find_row, keep_values, preview, with_row_number
from .rules import check_formulas, evaluate_rules

__all__ = ["clean_table", "cleaning_summary", "drop_duplicate_rows", "merge_rows", "unify_spelling", "column_profile",
           "compare_columns", "compare_rows", "compare_schema", "compare_tables", "exact_compare", "profile_columns",
           "rowwise_compare", "value_overlap", "fuzzy_compare", "pivot_table", "check_quality", "duplicate_rows",
           "similar_values", "quantiles", "distinct_values", "find_row", "keep_values", "preview", "with_row_number",
           "check_formulas", "evaluate_rules"]
