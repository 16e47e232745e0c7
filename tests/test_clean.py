import datetime as dt

from pyspark.sql import functions as F

from sheetwise.functions.numeric_text import parse_bool_text, with_numeric_parse
from sheetwise.operators import clean as C


def parse(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [tuple(r["p"]) for r in with_numeric_parse(df, {"v": "p"}).select("p").collect()]


def test_numeric_text_forms(spark):
    out = parse(spark, ["$1,200.50", "45,000 Naira", "45%", "(1,200)", "n/a", "-", "1d", "NaN",
                        "Infinity", " 7 ", "12 USD", "($5)"])
    assert out[0] == (1200.5, "USD", False)
    assert out[1] == (45000.0, "NGN", False)
    assert out[2] == (45.0, None, True)
    assert out[3] == (-1200.0, None, False)
    assert [o[0] for o in out[4:9]] == [None] * 5
    assert out[9][0] == 7.0 and out[10] == (12.0, "USD", False) and out[11] == (-5.0, "USD", False)


def test_bool_text(spark):
    df = spark.createDataFrame([(" Yes",), ("no",), ("T",), ("maybe",), (None,)], "v string")
    assert [r[0] for r in df.select(parse_bool_text(F.col("v"))).collect()] == [True, False, True, None, None]


def test_duplicates_removed(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")] * 2, "a long, b string")
    _, before, removed = C.drop_duplicates(df)
    assert (before, removed) == (6, 3)
    cleaned, _, rep = C.clean(df)
    assert rep["duplicates_removed"] == 3 and cleaned.count() == 3


def test_median_and_mode_fill(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (None, "b"), (3.0, None)], "num double, cat string")
    cleaned, _, rep = C.clean(df)
    rows = sorted((r["num"], r["cat"]) for r in cleaned.collect())
    assert (2.0, "b") in rows and (3.0, "a") in rows
    assert rep["missing_by_col"] == {"num": 1, "cat": 1} and rep["total_missing"] == 2


def test_currency_percent_boolean_conversion(spark):
    df = spark.createDataFrame([("$1,200.50", "45%", "yes"), ("$980", "12%", "no"), ("$15", "99%", "Yes")],
                               "v string, p string, flag string")
    cleaned, _, rep = C.clean(df)
    assert cleaned.columns == ["v (USD)", "p (%)", "flag"]
    assert rep["currency_columns_converted"] == {"v": "v (USD)"}
    assert rep["percent_columns_converted"] == ["p (%)"]
    assert rep["boolean_columns_converted"] == ["flag"]
    assert sorted(r[0] for r in cleaned.select("`v (USD)`").collect()) == [15.0, 980.0, 1200.5]


def test_currency_word_and_several_currencies(spark):
    df = spark.createDataFrame([("45,000 Naira", "$5"), ("1,000 naira", "£7")], "a string, b string")
    cleaned, _, rep = C.clean(df)
    assert "a (NGN)" in cleaned.columns and "b" in cleaned.columns  # two currencies: no code
    assert dict(cleaned.dtypes)["b"] == "double"


def test_identifier_column_stays_text(spark):
    df = spark.createDataFrame([("536365",), ("536366",), ("C536379",)], "invoice_no string")
    cleaned, _, _ = C.clean(df)
    assert dict(cleaned.dtypes)["invoice_no"] == "string"


def test_iso_and_day_first_dates(spark):
    iso = spark.createDataFrame([("2020-01-05", 1), ("2020-02-10", 2), ("2020-03-15", 3)], "date string, val long")
    c1, _, rep = C.clean(iso)
    assert dict(c1.dtypes)["date"] == "timestamp_ntz" and rep["date_cols"] == ["date"]
    dayfirst = spark.createDataFrame([("19-02-2020", 1), ("05-02-2020", 2), ("25-12-2020", 3)], "date string, val long")
    c2, _, _ = C.clean(dayfirst)
    got = sorted(r["date"] for r in c2.collect())
    assert got[0] == dt.datetime(2020, 2, 5) and got[-1] == dt.datetime(2020, 12, 25)


def test_partly_bad_dates(spark):
    vals = [f"2020-01-{d:02d}" for d in range(1, 9)] + ["not a date", "garbage"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(vals)], "date string, val long")
    cleaned, _, _ = C.clean(df)
    assert cleaned.where(F.col("date").isNull()).count() == 2


def test_text_that_is_mostly_not_numbers_stays_text(spark):
    df = spark.createDataFrame([("1d",), ("NaN",), ("Infinity",), ("5",)], "v string")
    cleaned, _, _ = C.clean(df)
    assert dict(cleaned.dtypes)["v"] == "string"


def test_all_null_text_column_gets_unknown(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a long, t string")
    cleaned, _, rep = C.clean(df)
    assert {r["t"] for r in cleaned.collect()} == {"Unknown"} and rep["missing_by_col"] == {"t": 2}


def test_longest_currency_word_wins(spark):
    out = parse(spark, ["7 dollars and 3 pounds sterling", "4 rupees pounds", "3 pounds sterling", "6 Dollar"])
    assert [o[1] for o in out] == ["GBP", "GBP", "GBP", "USD"]
    assert out[2][0] == 3.0 and out[0][0] is None


def test_nested_columns_pass_through(spark):
    df = spark.createDataFrame([({"a": 1}, [1.0, 2.0], "x"), ({"a": 1}, [1.0, 2.0], "x"), ({"b": 2}, [3.0], "x")],
                               "m map<string,int>, v array<double>, t string")
    cleaned, _, rep = C.clean(df)
    assert rep["duplicates_removed"] == 1 and cleaned.count() == 2
    assert dict(cleaned.dtypes)["m"] == "map<string,int>" and dict(cleaned.dtypes)["v"] == "array<double>"


def test_values_are_read_once_for_all_their_rows(spark, monkeypatch):
    rows = [(i, "$1,000.50" if i % 2 else "$2", "31/12/2020", f"x{i % 3}") for i in range(60)] + [(60, None, None, None)]
    df = spark.createDataFrame(rows, "i int, `a, (b)` string, day string, t string")
    read = []
    monkeypatch.setattr(C, "_date_counts", lambda values, places, f=C._date_counts: read.append(
        values.where(F.col("k").isin(*places)).count()) or f(values, places))
    cleaned, _, report = C.clean(df)
    assert read == [4]  # one date and three words, not 61 rows each
    assert report["date_cols"] == ["day"] and report["currency_columns_converted"] == {"a, (b)": "a, (b) (USD)"}
    last = cleaned.where("i = 60").first()
    assert last[1] == 501.25 and str(last["day"]) == "2020-12-31 00:00:00" and last["t"] == "x0"
    odd = spark.createDataFrame([(None, "x")], "v void, s string")  # a type that Parquet has not
    assert C.clean(odd)[0].count() == 1
