"""Run named queries against their SQL in DuckDB: python tests/compare_sql.py [folder] [name ...]"""

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows_of(cursor_or_df):
    """Rows with columns in name order, values in a comparable form."""
    if hasattr(cursor_or_df, "columns"):
        names = cursor_or_df.columns
        data = [tuple(r) for r in cursor_or_df.collect()]
    else:
        names = [d[0] for d in cursor_or_df.description]
        data = cursor_or_df.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6) + 0.0
        if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
            return v
        return str(v)

    return [names[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in data),
                                             key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def open_tables(folder):
    import duckdb
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def differences(spark, con, folder, name, query, sql):
    """Empty text when the results agree; otherwise what differs."""
    names, got = rows_of(query(spark, folder))
    if sql is None:
        return "" if got else "no rows"
    expected_names, expected = rows_of(con.execute(sql))
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if len(got) != len(expected):
        return f"{len(got)} rows, SQL has {len(expected)}; e.g. {got[:2]} / {expected[:2]}"
    bad = [(g, e) for g, e in zip(got, expected) if [type(x) for x in g] != [type(x) for x in e] or g != e]
    return f"{len(bad)} rows differ, e.g. {bad[:2]}" if bad else ""


def session(cpus="8"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), open_tables(folder)
    sql = entry.oracle_sql()
    failed = 0
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and not any(a in name for a in sys.argv[2:]):
            continue
        start = time.time()
        try:
            problem = differences(spark, con, folder, name, query, sql.get(name))
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok' if name in sql else 'ran'} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print("failed:", failed)
