"""Reading tables from files and writing results."""

from .readers import load_table, load_tables, read_delimited, tidy_table
from .writers import append_run_log, cleaned_path, resolve_output, save_table, write_results

__all__ = ["load_table", "load_tables", "read_delimited", "tidy_table", "append_run_log", "cleaned_path",
           "resolve_output", "save_table", "write_results"]
