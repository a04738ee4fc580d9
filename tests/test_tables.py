"""Cleaning, quality, pivots, reports, files and plans on small tables."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tabwright.operators import (check_formulas, check_quality, clean_table, compare_tables, evaluate_rules, pivot_table,
                                 quantiles, similar_values, with_row_number)
from tabwright.functions.numbers import exact_sum
from tabwright.operators.clean import spelling_corrections
from tabwright.operators.quality import _examples
from tabwright.operators.running import running_count
from tabwright.plans import report, run_task
from tabwright.plans.report import measure_totals
from tabwright.sources import append_run_log, load_table, load_tables, resolve_output, write_results

# loans of an instrument shop, with a fault of every kind
DEMO = [("Amber Quartet", "Linden", "Strings", "EUR 640", "2026-04-02", "0091-17"),
        ("Bass Brothers", "Marsh", "Strings", "1,380.25", "03/04/2026", "0091-18"),
        ("Copper Kettle Band", "Old Port", "Brass", "٧٢٠", "9 Apr 2026", "-"),
        ("Dulcimer House", " linden", "Strings", "415", "2026-04-11", "0091-20"),
        ("Evening Choir", "Marsh", "Voice", "$2,060", "N/A", "0091-21"),
        ("Fife and Drum", "OLD PORT", "Winds", "98", "04/04/2026", "0091-22"),
        ("Gable Organists", "Linden", "Keys", "(155)", "2031-02-20", "0091-23"),
        ("Harbour Ensemble", "Old Prt", "Winds", "3300", "2026-04-25", "0091-24"),
        (" Amber Quartet", "Linden", "Strings", "EUR 640", "2026-04-02", "0091-17")]
RULES = [{"column": "Fee", "min": 0}, {"column": "Lent", "not_future": True}, {"column": "Borrower", "required": True}]
DAY = "2026-06-01"


@pytest.fixture(scope="module")
def demo(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(DEMO)],
                                 "_row bigint, Borrower string, Town string, Family string, Fee string, Lent string, Loan string")


def test_clean_demo(demo):
    r = clean_table(demo, {"rules": RULES}, as_of=DAY)
    rows = r.data.orderBy("_row").collect()
    assert [x["Fee"] for x in rows] == [640, 1380.25, 720, 415, 2060, 98, -155, 3300]
    assert rows[1]["Lent"] == dt.datetime(2026, 4, 3) and rows[4]["Lent"] is None
    assert rows[2]["Loan"] is None and rows[0]["Loan"] == "0091-17"
    assert [x["Town"] for x in rows] == ["Linden", "Marsh", "OLD PORT", "Linden", "Marsh", "OLD PORT", "Linden", "Old Prt"]
    assert {(p.row_in_file, p.column) for p in r.problems.collect()} == {(8, "Fee"), (8, "Lent")}
    log = {(x.step, x.column): x.cells_changed for x in r.log.collect()}
    assert log[("Text -> number", "Fee")] == 9 and log[("Removed identical duplicate rows", "(whole row)")] == 1


def test_quality_demo(demo):
    q = check_quality(demo, as_of=DAY)
    codes = {(i.column, i.code): i.cells for i in q.issues.collect()}
    assert codes[("Town", "variants")] == 6 and codes[("Lent", "ambiguous")] == 1
    assert codes[("(whole row)", "hidden_rows")] == 1 and codes[("Fee", "negative")] == 1
    assert [(s.similar_value, s.similarity_pct) for s in q.similar.where("column = 'Town'").collect()] == [("Old Prt", 93)]
    assert {r.row_in_file for r in q.duplicates.collect()} == {2, 10}
    kinds = {c.column: c.type_found for c in q.columns.collect()}
    assert kinds["Fee"] == "number (stored as text)" and kinds["Lent"] == "date (stored as text)"


def test_unread_values_are_listed(spark):
    rows = [(i, f"{i}.50", "2026-01-%02d" % (i + 1)) for i in range(19)] + [(19, "many", "soon")]
    r = clean_table(spark.createDataFrame(rows, "_row bigint, n string, d string"))
    assert {(p.row_in_file, p.column, p.value, p.problem) for p in r.problems.collect()} == {
        (21, "n", "many", "Not a valid number - left empty"), (21, "d", "soon", "Not a valid date - left empty")}
    assert r.data.where("_row = 19").first()["n"] is None
    notes = {x.step: x.note for x in r.log.collect()}
    assert notes["Text -> number"].startswith("1 value(s)")


def test_cleaned_rows_do_not_wait_for_the_log(spark, monkeypatch):
    """Without "auto" no column is judged by its looks, and the log is made when it is asked for."""
    from tabwright.operators import clean
    made = []
    monkeypatch.setattr(clean, "column_facts", lambda *a: pytest.fail("columns were judged"))
    monkeypatch.setattr(clean, "_duplicate_log", lambda *a, keep=clean._duplicate_log: made.append(1) or keep(*a))
    df = spark.createDataFrame([(0, "1,000", "2026-01-02", "ab"), (1, "2", "2026-01-02", "AB"), (2, "2", "2026-01-02", "ab")],
                               "_row bigint, n string, d string, t string")
    r = clean_table(df, {"to_number": ["n"], "to_date": ["d"]})
    assert [(x._row, x.n, str(x.d), x.t) for x in r.data.orderBy("_row").collect()] == [
        (0, 1000, "2026-01-02 00:00:00", "ab"), (1, 2, "2026-01-02 00:00:00", "ab")]
    assert r.data.schema["n"].dataType.simpleString() == "bigint" and not made
    assert {x.step: x.cells_changed for x in r.log.collect()}["Unified spelling variants (case/spaces)"] == 1 and made


def test_cleaning_settings_are_checked(demo):
    for bad in ({"to_number": "yes"}, {"decimal": ";"}, {"fix_case": {"Town": "loud"}}, {"fix_case": {"City": "upper"}},
                {"merge": {"key": []}}, {"merge": {"key": ["Town"], "how": {"Fee": "product"}}},
                {"rules": [{"column": "Town"}]}, {"rules": [{"column": "Town", "minimum": 1}]}, {"rules": [{"min": 1}]}):
        with pytest.raises(ValueError):
            clean_table(demo, bad)


def test_rules(spark):
    df = spark.createDataFrame([(0, "a", 5.0, 1.0), (1, "A ", 15.0, 20.0), (2, None, None, 3.0), (3, "bb", 1.0, 1.0)],
                               "_row bigint, t string, x double, y double")
    rules = [{"column": "t", "unique": True, "pattern": "[a-z]"}, {"column": "x", "max": 10, "not_after": "y"},
             {"column": "gone", "required": True}, {"column": "t", "required": True, "allowed": ["A", "b"]}]
    found = {(p.row_in_file, p.column, p.problem.split(" ")[0]) for p in evaluate_rules(df, rules).collect()}
    assert found == {(2, "t", "Repeated"), (3, "t", "Repeated"), (3, "t", "Does"), (5, "t", "Does"), (3, "x", "Must"),
                     (2, "x", "Is"), (4, "t", "Empty,"), (5, "t", "Not")}


def test_quantiles_agree_with_the_built_in_percentile(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', cast(id % 7 as string)) as g", "cast((id * 37) % 501 as double) as v")
    one = {(r.g, r.n): r.q for r in df.groupBy("g").agg(F.count("v").alias("n"), F.expr("percentile(v, array(0.1, 0.5, 0.9))").alias("q")).collect()}
    two = {(r.g, r["count"]): r.quantiles for r in quantiles(df, ["g"], "v", [0.1, 0.5, 0.9]).collect()}
    assert one.keys() == two.keys()
    assert all(one[k] == pytest.approx(two[k]) for k in one)


def test_row_numbers_and_running_counts(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "if(id < 600, 0, id % 5) as g")
    numbered = with_row_number(df.repartition(7), ["k"])
    assert numbered.where("k <> _row").count() == 0
    counted = running_count(df.repartition(5), ["g"], "k")
    expected = df.selectExpr("*", "row_number() over (partition by g order by k) - 1 as b", "count(*) over (partition by g) as t")
    assert counted.join(expected, ["g", "k"]).where("_before <> b or _total <> t").count() == 0


def test_pivot_with_blank_and_total_labels(spark):
    df = spark.createDataFrame([("Total", "x", 1.0), (None, "x", 2.0), ("a", None, 4.0), ("a", "y", None)],
                               "r string, c string, v double")
    p = {tuple(r) for r in pivot_table(df, ["r"], ["c"], ["v"]).collect()}
    assert p == {("(blank)", 0.0, 2.0, 0.0, 2.0), ("Total", 0.0, 1.0, 0.0, 1.0), ("a", 4.0, 0.0, 0.0, 4.0),
                 ("Total", 4.0, 3.0, 0.0, 7.0)}
    two = pivot_table(df, ["r", "c"], [], ["v"], "count")
    assert ("Total", "", 3) in {tuple(r) for r in two.collect()}
    with pytest.raises(ValueError):
        pivot_table(df)


def test_reconcile_repeated_and_missing_keys(spark):
    a = spark.createDataFrame([("1", 1.0), ("1", 2.0), (None, 3.0)], "k string, v double")
    b = spark.createDataFrame([(1.0, 1.0), (None, 3.0), (9.0, 9.0)], "k double, v double")
    r = compare_tables(a, b, ["k"])
    assert tuple(r.stats.first()) == (3, 3, 3, 1, 0, 1, 1, 0)
    assert [tuple(x) for x in r.diffs.collect()] == [("1", "v", "2.0", "1.0", -1.0)]
    assert tuple(compare_tables(a, b, ["k"], tolerance=1.0).stats.first())[3] == 0


def sales(spark):
    """420 invoices: 7 discounted amounts, 30 amounts and 40 dates as text, 15 cities in capitals."""
    i = F.col("id")
    price, qty = (i * 13 % 97 + 5) / 4 + 0.25, i % 19 + 1
    amount = F.bround(price * qty, 2)
    amount = F.when(i % 60 == 7, F.bround(amount * 0.9, 2)).otherwise(amount)
    day = F.date_add(F.lit("2025-10-01").cast("date"), (i * 7 % 365).cast("int"))
    city = F.element_at(F.array(*[F.lit(c) for c in ("Riverside", "Hillview", "Lakeside", "Brookfield")]), (i % 4 + 1).cast("int"))
    return spark.range(420).select(
        i.alias("_row"), F.format_string("INV-%04d", i + 1).alias("Invoice No"),
        F.when(i % 28 == 3, F.concat(F.upper(city), F.lit(" "))).otherwise(city).alias("City"),
        price.alias("Unit Price"), qty.alias("Quantity"),
        F.when(i % 14 == 5, F.format_number(amount, 2)).otherwise(amount.cast("string")).alias("Amount"),
        F.when(i % 21 < 2, F.date_format(day, "dd/MM/yyyy")).otherwise(day.cast("string")).alias("Invoice Date"))


CHECK = {"name": "Amount", "check": "[Amount]", "equals": "[Unit Price] * [Quantity]", "tolerance": 0.011}


def test_formula_checks_find_the_planted_rows(spark):
    s = sales(spark)
    checked = check_formulas(s, [CHECK], ["Invoice No"])
    row = checked.summary.first()
    assert (row.rows_checked, row.mismatches, row.could_not_check) == (420, 7, 0)
    assert checked.mismatches.count() == 7


def test_report(spark):
    made = report(sales(spark), {
        "date_column": "Invoice Date", "period": "month", "value_columns": ["Amount"], "category_column": "City", "top_n": 2,
        "pivot_rows": ["City"], "pivot_columns": ["Period"], "pivot_values": ["Amount"], "formula_checks": [CHECK],
        "include_data": True}, as_of="2026-12-01")
    assert set(made) == {"Summary", "Trend", "By City", "Trend by City", "Pivot", "Formula checks", "Formula mismatches",
                         "Cleaning log", "Data problems", "Data"}
    assert made["Trend"].count() == 12 and made["Data"].select("City").distinct().count() == 4
    assert [r[0] for r in made["By City"].collect()][-1] == "Other" and len(made["Pivot"].columns) == 14
    items = {r.item: r.value for r in made["Summary"].collect()}
    assert items["Rows in report"] == "420" and items["City - distinct values"] == "4"
    assert items["Check: Amount"] == "7 mismatch(es) in 420 rows (0 could not be checked)"
    with pytest.raises(ValueError):
        report(sales(spark), {"date_column": "Nope"})


def test_tasks(spark, demo):
    checked = run_task("check_data", demo, cleaning={"rules": RULES}, as_of=DAY)
    items = {r.item: r.value for r in checked["Summary"].collect()}
    assert int(items["Problems to fix"]) >= 7 and items["Data problems (rules / unreadable values)"] == "2"
    b = demo.withColumn("Town", F.lower("Town"))
    compared = run_task("compare_tables", demo, b, {"key_a": ["Borrower"], "key_b": ["Borrower"]}, as_of=DAY)
    assert {r.item: r.value for r in compared["Summary"].collect()}["matched"] == "8"
    columns = run_task("compare_columns", demo, b, {"column_a": "Town", "column_b": "Town"}, apply_cleaning=False)
    assert columns["Values in both"].count() == 1
    rows = run_task("compare_rows", demo, b, {"by_a": "row_number", "value_a": 0, "by_b": "Town", "value_b": "Marsh"})
    assert rows["Row comparison"].count() == 6
    with pytest.raises(ValueError):
        run_task("nonsense", demo)


def test_files(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    with open(path, "wb") as f:
        f.write("﻿code;n;x;text;none\n007;1;1.5;\"a;b\";\n010;2;;N/A;\n;;;;\n012;3;2;شيء;\n".encode())
    df = load_table(spark, path)
    assert df.dtypes == [("code", "string"), ("n", "bigint"), ("x", "double"), ("text", "string"), ("_row", "bigint")]
    assert [tuple(r) for r in df.orderBy("_row").collect()] == [
        ("007", 1, 1.5, "a;b", 0), ("010", 2, None, None, 1), ("012", 3, 2.0, "شيء", 2)]
    windows = str(tmp_path / "w.txt")
    with open(windows, "wb") as f:
        f.write("name,n\nشركة,1\n".encode("cp1256"))
    assert load_table(spark, windows).first()["name"] == "شركة"
    out = write_results({"Sheet: 1": df}, str(tmp_path / "out"))
    assert os.path.basename(out["Sheet: 1"]) == "Sheet__1" and spark.read.parquet(out["Sheet: 1"]).count() == 3
    log = str(tmp_path / "log")
    for n in (1, 2):
        append_run_log(spark, log, {"task": "report", "seconds": n})
    assert spark.read.parquet(log).count() == 2
    assert load_tables(spark, {"t1": path})["t1"].count() == 3 and spark.table("t1").count() == 3
    assert resolve_output("r/{profile}_{month}", "m", dt.datetime(2026, 3, 1)) == "r/m_2026-03"
    for bad in ("", "x.xlsx"):
        with pytest.raises(ValueError):
            load_table(spark, bad)


def test_no_cartesian_and_pushed_down(spark, demo):
    """Plans: no cross join in candidate search; columns and filters reach the scan."""
    from tabwright.operators.candidates import similar_texts
    nodes = spark.createDataFrame([(1, "", "abcdef"), (2, "", "abcdeg")], "id bigint, block string, text string")
    plan = similar_texts(nodes, nodes, 85)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumn("_row", F.col("o_orderkey"))
    plan = evaluate_rules(orders, [{"column": "o_totalprice", "max": 1}])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_every_similar_pair_counts(spark):
    """Twenty values that all resemble each other: 190 pairs, whatever a list may show of them."""
    df = spark.createDataFrame([(i, "northern gate " + c) for i, c in enumerate("abcdefghijklmnopqrst")], "_row bigint, t string")
    q = check_quality(df, as_of=DAY)
    assert q.similar.count() == 190 and q.issues.where("code = 'typos'").first().cells == 190
    short = check_quality(df, as_of=DAY, similar_limit=30)
    assert short.similar.count() == 30 and short.issues.where("code = 'typos'").first().cells == 190


def test_settings_may_name_columns_of_one_table(spark):
    a = spark.createDataFrame([(0, "x", -1.0, "ab"), (1, "y", 2.0, "cd")], "_row bigint, k string, only_a double, t string")
    b = spark.createDataFrame([(0, "x", "old"), (1, "y", "new")], "_row bigint, k string, only_b string")
    cleaning = {"rules": [{"column": "only_a", "min": 0}, {"column": "only_a", "not_after": "only_b"}], "fix_case": {"t": "upper"},
                "replace": {"only_b": {"old": "new"}}, "to_number": ["only_a"], "merge": {"key": ["k"], "how": {"only_a": "sum"}}}
    cleaning["rules"] = cleaning["rules"][:1]
    for task, options in (("compare_tables", {"key_a": ["k"], "key_b": ["k"]}), ("clean_data", {})):
        made = run_task(task, a, b, options, cleaning)
        assert [tuple(r) for r in made["Data problems"].select("table", "column").collect()] == [("A", "only_a")], task
        steps = {(r.table, r.column) for r in made["Cleaning log"].collect()}
        assert {("A", "t"), ("B", "only_b")} <= steps
    with pytest.raises(ValueError):
        run_task("clean_data", a, b, {}, {"rules": [{"column": "nowhere", "min": 0}]})


def test_pivot_labels_that_read_alike(spark):
    df = spark.createDataFrame([("r", "Total", "c", 1.0, 7), ("r", "a | b", "c", 2.0, 7), ("r", "a", "b | c", 4.0, 7)],
                               "r string, c string, d string, v double, `Row count` int")
    one = pivot_table(df, ["r"], ["c"], ["v"])
    assert one.columns == ["r", "Total", "a", "a | b", "Total (2)"]
    assert [tuple(x) for x in one.collect()] == [("r", 1.0, 4.0, 2.0, 7.0), ("Total", 1.0, 4.0, 2.0, 7.0)]
    two = pivot_table(df, ["r"], ["c", "d"], ["v"], totals=False)
    assert two.columns == ["r", "Total | c", "a | b | c", "a | b | c (2)"] and tuple(two.first()) == ("r", 1.0, 4.0, 2.0)
    assert tuple(pivot_table(df, ["r"], [], ["Row count"]).first()) == ("r", 21.0)
    assert pivot_table(df, [], ["c"], ["Row count"]).columns == ["Value", "Total", "a", "a | b", "Total (2)"]


def test_no_other_category_without_others(spark):
    from tabwright.plans.report import trend_by_category
    df = spark.createDataFrame([("2026-01-05", "a", 1.0), ("2026-02-05", "b", 3.0)], "d string, c string, v double")
    assert trend_by_category(df, "d", "month", "c", "v", "sum", 5).columns == ["Month", "b", "a"]
    assert trend_by_category(df, "d", "month", "c", "v", "sum", 1).columns == ["Month", "b", "Other"]


def test_results_with_like_names_stay_apart(spark, tmp_path):
    out = write_results({"a b": spark.range(1), "a_b": spark.range(2), "A?b": spark.range(3).selectExpr("id as `x y`", "id as x_y")},
                        str(tmp_path))
    assert [spark.read.parquet(out[n]).count() for n in ("a b", "a_b", "A?b")] == [1, 2, 3]
    assert spark.read.parquet(out["A?b"]).columns == ["x_y", "x_y_2"]


def test_missing_numbers_are_one_value(spark):
    from tabwright.operators.clean import drop_duplicate_rows
    from tabwright.operators.quality import exact_and_hidden_duplicates
    df = spark.createDataFrame([(0, float("nan"), "x"), (1, None, "x"), (2, 1.0, "x")], "_row bigint, v double, t string")
    assert {r["_row"] for r in drop_duplicate_rows(df).collect()} == {0, 2}
    assert tuple(exact_and_hidden_duplicates(df).first()) == (1, 0)
    cleaned = clean_table(df)
    assert cleaned.log.where("step = 'Removed identical duplicate rows'").first().example_before == "rows 3"


def test_empty_tables_have_their_lines(spark):
    df = spark.createDataFrame([], "_row bigint, t string, v double")
    assert [tuple(r)[1:] for r in check_formulas(df, [{"check": "[v]", "equals": "[v]"}]).summary.collect()] == [(0, 0, 0, 0.0)]
    assert {r.item: r.value for r in check_quality(df, as_of=DAY).overview.collect()}["Empty cells"] == 0


def test_line_breaks_in_quotes_and_file_order(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a,b\n"one\ntwo",1\nthree,2\n')
    assert [tuple(r) for r in load_table(spark, str(tmp_path / "q.csv")).orderBy("_row").collect()] == [("one\ntwo", 1, 0), ("three", 2, 1)]
    folder = tmp_path / "several.csv"
    folder.mkdir()
    for name, first, n in (("a", 0, 3), ("b", 3, 5000), ("c", 5003, 10)):
        (folder / f"{name}.csv").write_text("n\n" + "\n".join(str(i) for i in range(first, first + n)) + "\n")
    assert load_table(spark, str(folder)).where("n <> _row").count() == 0
    (tmp_path / "t.tsv").write_text("x\ty\n1\ta,b\n")
    assert tuple(load_table(spark, str(tmp_path / "t.tsv")).first()) == (1, "a,b", 0)


def test_headers_and_breaks_of_files(spark, tmp_path):
    from tabwright.sources import load_table
    from tabwright.sources.readers import header_names, profile_text
    (tmp_path / "a.csv").write_text('a,a,b,A\n1,2,"x\ny",4\n5,6,z,8\n')
    (tmp_path / "b.csv").write_text('a,a,b,A\n9,10,12" pipe,12\n13,14,"q, ""r""",16\n')
    assert [f.rsplit("/", 1)[1] for f in profile_text(spark, str(tmp_path))[1]] == ["a.csv"]
    made = load_table(spark, str(tmp_path), "csv", order_by=["a"])
    assert sorted(c for c in made.columns if c != "_row") == ["A.2", "a", "a.1", "b"]
    assert [(r["a"], r["a.1"], r["b"], r["A.2"]) for r in made.orderBy("a").collect()] == [
        (1, 2, "x\ny", 4), (5, 6, "z", 8), (9, 10, '12" pipe', 12), (13, 14, 'q, "r"', 16)]
    assert header_names(["x", "", "x", "x.1"], ["_c0", "_c1", "_c2", "_c3"]) == ["x", "_c1", "x.1", "x.1.1"]


def test_typo_search_broadcasts_nothing_that_grows(spark):
    values = spark.createDataFrame([(0, f"customer number{c}", 1) for c in "abcdefgh"] + [(0, "lone 7", 1), (1, "lone 7", 1)],
                                   "position int, value string, n bigint")
    pairs = similar_values(values)
    assert "BroadcastExchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.count() == 28 and not pairs.where("value = 'lone 7'").count()


def test_spelling_corrections_broadcast_nothing_that_grows(spark):
    values = spark.createDataFrame([(0, v, n) for v, n in (("Linden", 3), ("LINDEN", 1), ("Marsh", 1))], "position int, value string, n bigint")
    fixes = spelling_corrections(values)
    assert "BroadcastExchange" not in fixes._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in fixes.collect()] == [(0, "LINDEN", "Linden")]


def test_sums_keep_their_cents(spark):
    rows = spark.range(200000).select(F.lit(2251403.61).alias("x"), F.lit(0.1).alias("y"))
    made = {r.column: r.total for r in measure_totals(rows.coalesce(1), ["x", "y"]).collect()}
    assert made == {"x": 450280722000.0, "y": 20000.0}
    assert rows.coalesce(1).agg(exact_sum(F.col("y"))).first()[0] == 20000.0
    odd = spark.createDataFrame([(1e300, -0.25, None), (-2.0, 0.5, None), (None, -3.0, None)], "a double, b double, c double")
    assert tuple(odd.agg(*[exact_sum(F.col(c)) for c in "abc"]).first()) == (1e300, -2.75, None)
    assert odd.unionAll(odd.limit(0)).agg(exact_sum(F.lit(float("inf")))).first()[0] == float("inf")


def test_flags_are_worked_out_once(spark):
    flagged = spark.range(1000, numPartitions=1).select(F.lit(0).alias("position"), F.lit(1).alias("n"), F.lit("f").alias("flag"),
                                                        (F.col("id") % 5).cast("string").alias("shown"), F.col("id").cast("double").alias("rank"))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def met(x):
        seen.add(1)
        return x

    found = _examples(flagged.withColumn("shown", met.asNondeterministic()("shown")))
    assert [tuple(r) for r in found.collect()] == [(0, "f", 1000, 5, "0 | 1 | 2")] and seen.value == 1000
