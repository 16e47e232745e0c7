import os

import pytest

from sheetwise.operators import industry as IND
from sheetwise.sources import io as IO


def test_combine(spark):
    a = spark.createDataFrame([("n", 1)], "region string, revenue long")
    b = spark.createDataFrame([("s", 2, 5)], "region string, revenue long, cost long")
    combined, counts, summary = IO.combine([("jan.csv", a), ("feb.csv", b)])
    assert summary == {"files_combined": 2, "file_row_counts": {"jan.csv": 1, "feb.csv": 1},
                       "columns_matched": False, "total_rows": 2}
    assert combined.where("cost IS NULL").count() == 1
    with pytest.raises(ValueError):
        IO.combine([])


def test_rank_tables(spark):
    data = spark.createDataFrame([(f"r{i}", i, i) for i in range(20)], "region string, revenue long, cost long")
    notes = spark.createDataFrame([("x",), ("y",), ("z",)],
                                  "`these are long instructions for whoever opens this sheet first` string")
    ranked = [r["name"] for r in IO.rank_tables({"notes": notes, "data": data}).collect()]
    assert ranked == ["data", "notes"]


def test_read_csv_encoding_fallback_and_types(spark, tmp_dir):
    p = os.path.join(tmp_dir, "f.csv")
    with open(p, "wb") as fh:
        fh.write("name,amount,flag\n".encode())
        fh.write("caf\xe9,1.5,True\n".encode("cp1252"))
        fh.write("\xa3 shop,NA,False\n".encode("cp1252"))
    df = IO.read_table(spark, p)
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("café", 1.5, True), ("£ shop", None, False)]
    with pytest.raises(ValueError):
        IO.read_table(spark, os.path.join(tmp_dir, "x.xlsx"))


def test_saved_analysis_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a")], "x long, y string")
    aid = IO.save_analysis(spark, tmp_dir, "u1", "first", df, {"cleaned_rows": 1, "original_cols": 2})
    listed = IO.list_saved_analyses(spark, tmp_dir, "u1").collect()
    assert [r["analysis_id"] for r in listed] == [aid]
    data, rep = IO.load_analysis(spark, tmp_dir, "u1", aid)
    assert data.collect()[0]["y"] == "a" and rep["cleaned_rows"] == 1


def test_export_report(spark, tmp_dir):
    df = spark.createDataFrame([(1, True, -0.5)], "weekly_sales long, _anomaly boolean, _anomaly_score double")
    paths = IO.export_report(os.path.join(tmp_dir, "rep"), df)
    back = spark.read.option("header", True).csv(paths[0])
    assert back.columns == ["Weekly Sales"]


def test_industry_by_names(spark):
    cat = spark.createDataFrame(
        [("till", c) for c in ["shop", "sales_eur", "discount_code", "customer_type"]] + [("misc", "a"), ("misc", "b")],
        "table string, column string")
    got = {r["table"]: r["industry"] for r in IND.classify_tables(cat).collect()}
    assert got == {"till": "sales_retail", "misc": None}


def test_combine_files_single_scan(spark, tmp_dir):
    a = spark.createDataFrame([("n", 1)], "region string, revenue long")
    b = spark.createDataFrame([("s", 2, 5), ("e", 3, 6)], "region string, revenue long, cost long")
    a.write.parquet(os.path.join(tmp_dir, "jan"))
    b.write.parquet(os.path.join(tmp_dir, "feb"))
    combined, counts, summary = IO.combine_files(spark, [os.path.join(tmp_dir, "jan"), os.path.join(tmp_dir, "feb")])
    assert summary["total_rows"] == 3 and summary["columns_matched"] is False
    assert combined.where("cost IS NULL").count() == 1 and "source_file" in combined.columns


def test_csv_huge_integers_are_not_lost(spark, tmp_dir):
    p = os.path.join(tmp_dir, "big.csv")
    with open(p, "w") as fh:
        fh.write("id,n\n1,99999999999999999999\n2,5\n")
    rows = sorted(tuple(r) for r in IO.read_table(spark, p).collect())
    assert rows[0][0] == 1 and rows[0][1] == 1e20 and rows[1][1] == 5.0


def test_read_csv_drops_byte_order_mark(spark, tmp_dir):
    p = os.path.join(tmp_dir, "bom.csv")
    with open(p, "wb") as fh:
        fh.write("﻿region,revenue\nnorth,10\nsouth,20\n".encode("utf-8"))
    df = IO.read_table(spark, p)
    assert df.columns == ["region", "revenue"] and dict(df.dtypes)["revenue"] == "bigint"


def test_csv_files_with_other_headers_and_encodings(spark, tmp_dir):
    files = {"a": "x,y\n1,p\n".encode(), "b": "y,x\nq,2\n\nr,3\n".encode(), "c": "x,caf\xe9\n4,\x80\n".encode("latin-1"),
             "d": "\ufeffx,y\r\n5,\ufffd ok\r\n".encode(), "e": b"x,y\n6,\x81\xe9\n", "f": b'x,y\n7,"a ""b"", c"\n',
             "g": b"x,y\n"}
    for name, data in files.items():
        with open(os.path.join(tmp_dir, f"{name}.csv"), "wb") as fh:
            fh.write(data)
    rows = {r["x"]: (r["y"], r["café"]) for r in IO.read_csv(spark, os.path.join(tmp_dir, "*.csv")).collect()}
    assert rows == {1: ("p", None), 2: ("q", None), 3: ("r", None), 4: (None, "€"), 5: ("\ufffd ok", None),
                    6: ("\x81é", None), 7: ('a "b", c', None)}


def test_csv_quoted_line_breaks_on_request(spark, tmp_dir):
    path = os.path.join(tmp_dir, "m.csv")
    with open(path, "w") as fh:
        fh.write('a,b\n1,"two\nlines"\n')
    assert IO.read_csv(spark, path, multi_line=True).first()["b"] == "two\nlines"


def test_deleting_a_saved_analysis(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a")], "x long, y string")
    ids = [IO.save_analysis(spark, tmp_dir, user, name, df, {}) for user, name in (("u1", "n"), ("u1", "m"), ("u2", "n"))]
    assert not IO.delete_analysis(spark, tmp_dir, "u2", ids[0])
    assert IO.delete_analysis(spark, tmp_dir, "u1", ids[0])
    assert [r["analysis_id"] for r in IO.list_saved_analyses(spark, tmp_dir, "u1").collect()] == [ids[1]]
    assert IO.list_saved_analyses(spark, tmp_dir, "u2").count() == 1
    assert len(os.listdir(os.path.join(tmp_dir, "data"))) == 2  # the deleted table is gone


def test_dates_in_many_forms(spark):
    from pyspark.sql import functions as F

    from sheetwise.functions.dates import parse_timestamp
    forms = {"05-Jan-2020": "2020-01-05 00:00:00", "5/January/2020": "2020-01-05 00:00:00",
             "2020-01-05T10:00:00Z": "2020-01-05 10:00:00", "2020-01-05 10:00:00+02:00": "2020-01-05 08:00:00",
             "2020-01-05T10:00:00.5-0130": "2020-01-05 11:30:00.5", "1/5/2020 3:07 PM": "2020-01-05 15:07:00",
             "1/5/2020 12:00:01 am": "2020-01-05 00:00:01", "Jan 2020": "2020-01-01 00:00:00", "2020-01": "2020-01-01 00:00:00",
             "2020-01-05 10:00:00.123456789": "2020-01-05 10:00:00.123456", "Jan 5 2020": "2020-01-05 00:00:00",
             "2020-01-05T10:00": "2020-01-05 10:00:00", "soon": None, "": None, "12": None, "x" * 5000: None}
    df = spark.createDataFrame([(k, v) for k, v in forms.items()], "s string, want string")
    bad = df.withColumn("got", parse_timestamp(F.col("s"))).where("NOT (got <=> cast(want as timestamp_ntz))").collect()
    assert bad == []
