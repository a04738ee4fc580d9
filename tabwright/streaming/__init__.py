"""Row-local cleaning and rules on streams."""

from .row_local import append_problems, clean_rows, rule_problems

__all__ = ["append_problems", "clean_rows", "rule_problems"]
