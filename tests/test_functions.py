import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions import (difference, formula, letter_case, match_text, norm_text, parse_date, parse_number,
                                 period_label, plain_number, replace_values, tidy_spaces, value_text, values_equal)
from tabwright.functions.text import typed

TEXT = T.StringType()


def one(spark, values, make, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(make(F.col("x"))).collect()]


def test_numbers(spark):
    forms = {"1,250": 1250, "$1,250.50": 1250.5, "IQD 15,000": 15000, "١٢٣٤": 1234, "(500)": -500, "500-": -500, "15%": 15,
             "1,25": None, "-3.5": -3.5, "+7": 7, "1 000": 1000, "٣١٬٠٠٠٫٥": 31000.5, "abc": None, "": None, "12 euros": 12,
             "-(5)": -5, "(-5)": -5, "1.2.3": None, "N/A": None, None: None, "USD": None, "15%-": None, "٪5": None,
             "007": 7, "1e5": None, "د.ع 500": 500}
    got = one(spark, forms, lambda c: parse_number(c, TEXT))
    assert dict(zip(forms, got)) == forms
    assert one(spark, ["1.234,56", "1,5", "1.5", "12"], lambda c: parse_number(c, TEXT, ",")) == [1234.56, 1.5, None, 12]
    assert one(spark, [True, False], lambda c: parse_number(c, T.BooleanType()), "boolean") == [1.0, 0.0]


def test_plain_numbers(spark):
    assert one(spark, [" 12 ", "1e3", "1,250", "12d", ".5", "5.", "x"], lambda c: plain_number(c, TEXT)) == [
        12, 1000, None, None, 0.5, 5, None]


def test_dates(spark):
    day = dt.datetime
    forms = {"2026-03-01": day(2026, 3, 1), "01/03/2026": day(2026, 3, 1), "1 Mar 2026": day(2026, 3, 1),
             "5 September 2026": day(2026, 9, 5), "March 5, 2026": day(2026, 3, 5), "46082": day(2026, 3, 1),
             "31/31/2026": None, "03/25/2026": day(2026, 3, 25), "2026/3/1": day(2026, 3, 1), "1.3.2026": day(2026, 3, 1),
             "2026-03-01 14:05": day(2026, 3, 1, 14, 5), "2026-03-01T14:05:06Z": day(2026, 3, 1, 14, 5, 6), "N/A": None,
             "٠١/٠٣/٢٠٢٦": day(2026, 3, 1), "1-Mar-26": day(2026, 3, 1), "12 Marchy 2026": None, "": None, None: None,
             " 2026-03-01 ": day(2026, 3, 1), "19999": None, "30 Feb 2026": None,
             "01/03/2026 5:30 PM": day(2026, 3, 1, 17, 30), "01/03/2026 12:05 am": day(2026, 3, 1, 0, 5), "2026-03-01 12:00 p.m.": day(2026, 3, 1, 12),
             "01/03/2026 13:00 PM": None, "20260301": day(2026, 3, 1), "20261301": None, "Mar-01-2026": day(2026, 3, 1),
             "2026-Mar-01": day(2026, 3, 1), "Sunday, 1 March 2026": day(2026, 3, 1), "Sun 01/03/2026": day(2026, 3, 1), "March 2026": day(2026, 3, 1),
             "Mar-2026": day(2026, 3, 1), "2026-03": day(2026, 3, 1), "03/2026": day(2026, 3, 1), "13/2026": None, "Monk 1 March 2026": None}
    assert dict(zip(forms, one(spark, forms, lambda c: parse_date(c, TEXT)))) == forms
    assert one(spark, ["01/03/2026", "2026-01-03"], lambda c: parse_date(c, TEXT, False)) == [day(2026, 1, 3)] * 2
    assert one(spark, [46082.5, 5.0], lambda c: parse_date(c, T.DoubleType()), "double") == [day(2026, 3, 1, 12), None]


def test_period_labels(spark):
    days = [dt.date(2026, 3, 1), None]
    for period, label in (("day", "2026-03-01"), ("week", "Week of 2026-02-23"), ("month", "2026-03"), ("quarter", "2026-Q1"),
                          ("year", "2026")):
        assert one(spark, days, lambda c: period_label(c, period), "date") == [label, "(no date)"]


def test_number_text(spark):
    values = [1250.0, 0.5, 12345678.9, 1e-5, 1e16, 1.5e22, -0.001, 0.0005, 1e7, 1e15, 123456789012.25]
    assert one(spark, values, lambda c: value_text(c, T.DoubleType()), "double") == [repr(v) for v in values]


def test_norm_text(spark):
    assert one(spark, [" 1001 ", "1001.0", None, "A "], lambda c: norm_text(c, TEXT, True)) == ["1001", "1001", "", "a"]
    assert one(spark, [1001.0, 2.5, None], lambda c: norm_text(c, T.DoubleType()), "double") == ["1001", "2.5", ""]
    assert one(spark, [dt.datetime(2026, 3, 1), dt.datetime(2026, 3, 1, 5)], lambda c: norm_text(c, T.TimestampNTZType()),
               "timestamp_ntz") == ["2026-03-01", "2026-03-01 05:00:00"]


def test_norm_text_of_negative_zero_equals_sql(spark):
    import duckdb
    values = [-0.0, 0.0, -3.0, -0.01]
    sql = [duckdb.execute("SELECT regexp_replace(CAST(?::DOUBLE AS VARCHAR), '\\.0$', '')", [v]).fetchone()[0] for v in values]
    assert one(spark, values, lambda c: norm_text(c, T.DoubleType()), "double") == sql == ["-0", "0", "-3", "-0.01"]
    assert one(spark, ["-0.0"], lambda c: norm_text(c, TEXT)) == ["-0"]


def test_text_cleaning(spark):
    assert one(spark, ["  a​  b c ", "x‌y"], tidy_spaces) == ["a b c", "x‌y"]
    assert one(spark, ["o'neil smith-JONES", "ÉCOLE d'été"], lambda c: letter_case(c, "title")) == ["O'Neil Smith-Jones", "École D'Été"]
    assert one(spark, ["The Blue-River Co., Ltd!", "شركة النور (٢)"],
               lambda c: match_text(c, TEXT, ["co", "ltd", "the"])) == ["blue river", "شركة النور 2"]
    assert one(spark, [" HAWLER ", "x", None], lambda c: replace_values(c, {"hawler": "Erbil"})) == ["Erbil", "x", None]


@pytest.mark.parametrize("a,b,tol,case,same", [
    ("1.0", "1", 0, False, True), ("1,250", "1250", 0, False, False), ("5", "5.4", 0.5, False, True),
    (None, None, 0, False, True), ("", None, 0, False, False), ("Ab ", "aB", 0, True, True), ("Ab", "aB", 0, False, False)])
def test_values_equal(spark, a, b, tol, case, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(values_equal(typed(df, "a"), typed(df, "b"), tol, case)).first()[0] is same


def test_dates_and_differences(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 3, 1), dt.date(2026, 3, 1), "2026-03-01", 3.0, "5")],
                               "a timestamp_ntz, b date, c string, x double, y string")
    row = df.select(values_equal(typed(df, "a"), typed(df, "b")), values_equal(typed(df, "a"), typed(df, "c")),
                    difference(typed(df, "x"), typed(df, "y")), difference(typed(df, "a"), typed(df, "x"))).first()
    assert tuple(row) == (True, True, 2.0, None)


def test_formula(spark):
    df = spark.createDataFrame([("1,000", 4.0, 0.0)], "`Unit Price` string, q double, z double")
    assert df.select(formula(df, "-[Unit Price] * ([q] + 2) / 3"), formula(df, "[q] / [z]"), formula(df, 2)).first()[:] == (
        -2000.0, None, 2.0)
    for bad in ("[q] ** 2", "[q] // 2", "[nope] + 1", "__import__('os')", "[q] +", "q + 1"):
        with pytest.raises(ValueError):
            formula(df, bad)
