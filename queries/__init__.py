"""Named queries over the given tables, most with the same question in SQL."""

from . import cleaning, comparing, files, parsing, reporting

AREAS = (reporting, parsing, comparing, cleaning, files)


def all_queries() -> dict:
    return {name: fn for area in AREAS for name, (fn, _) in area.QUERIES.items()}


def all_sql() -> dict:
    return {name: sql for area in AREAS for name, (_, sql) in area.QUERIES.items() if sql}
