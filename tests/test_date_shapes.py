"""Dates in forms that no fixed pattern lists are read by shape."""

import random
from datetime import datetime

from sheetwise.functions import date_shapes as DS


def read(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, s string")
    got = {r.i: r.d for r in DS.read_dates(df, "s", "d").collect()}
    return [got[i] for i in range(len(texts))]


def test_layouts_follow_from_shapes():
    assert DS.layouts("99/99/9999") == ["mdy|", "dmy|"] and DS.layouts("99-99-99") == ["mdy|", "dmy|", "ymd|"]
    assert DS.layouts("9 B, 9999 9:99 P") == ["dyHM|PB"] and DS.layouts("9999.99.99") == ["ymd|"]
    assert DS.layouts("9999年9月99日") == ["ymd|"] and DS.layouts("99:99:99.F 9999/9/9") == ["HMSFymd|"]
    assert DS.layouts("W, 99 B 9999 99:99:99 +99:99") == ["dyHMShn|+B"]
    for shape in ("", "9999", "999.999", "99.99.99.99", "99 99", "9:99", "B 99", "9999-9999-99", "9-9-9", "99999", "9 W W 9999",
                  "9999/99/99/", "99/99/9999 99:99 99:99", "+99 999 9999"):
        assert DS.layouts(shape) == [], shape


def test_forms_outside_the_list(spark):
    forms = {"3rd of March, 2020 5:07 pm": (2020, 3, 3, 17, 7), "Tue, 05 May 2020 10:30:00 GMT": (2020, 5, 5, 10, 30),
             "Tue, 05 May 2020 10:30:00 +0200": (2020, 5, 5, 8, 30), "2020年1月5日": (2020, 1, 5), "2020.01.05": (2020, 1, 5),
             "2020-Jan-05": (2020, 1, 5), "20200105103000": (2020, 1, 5, 10, 30), "20200105T103000": (2020, 1, 5, 10, 30),
             "10:30 2020/01/05": (2020, 1, 5, 10, 30), "January 5th 2020": (2020, 1, 5), "5 Sept. 2020": (2020, 9, 5),
             "2020 January 5 10:30:15.25": (2020, 1, 5, 10, 30, 15, 250000), "Monday, January 5, 1998": (1998, 1, 5),
             "12 am 2020/01/05": (2020, 1, 5), "13 pm 2020/01/05": None, "31 of February 2020": None,
             "2020.13.05": None, "10.0.0.12": None, "soon": None, "": None, "x 2020": None, "９": None, None: None,
             "1" * 5000: None}
    for (text, want), got in zip(forms.items(), read(spark, list(forms)), strict=True):
        assert got == (want and datetime(*want)), text


def test_ranges_of_the_column_decide_the_order(spark):
    # 05.06.20 alone is open: June where another value shows that days come first
    assert read(spark, ["05.06.20", "25.06.20"]) == [datetime(2020, 6, 5), datetime(2020, 6, 25)]
    assert read(spark, ["05.06.20", "06.25.20"]) == [datetime(2020, 5, 6), datetime(2020, 6, 25)]
    assert read(spark, ["20.06.05", "21.06.25", "99.12.31"]) == [datetime(2020, 6, 5), datetime(2021, 6, 25), datetime(1999, 12, 31)]
    assert read(spark, ["05.06.20"]) == [datetime(2020, 5, 6)]
    # the order holds over the column's other shapes too
    assert read(spark, ["05.06.20", "25.06.20 10:00"])[0] == datetime(2020, 6, 5)


def test_many_forms_of_one_day(spark):
    rnd = random.Random(5)
    want, texts = [], []
    for _ in range(300):
        day = datetime(rnd.randint(1971, 2060), rnd.randint(1, 12), rnd.randint(1, 28), rnd.randint(0, 23), rnd.randint(0, 59))
        form = rnd.choice(["%A, %d of %B %Y %H:%M", "%Y.%m.%d %H:%M", "%H:%M:00 %d %b %Y", "%Y年%m月%d日 %H:%M", "%Y%m%d%H%M00",
                           "%a %d-%b-%Y %I:%M %p", "%Y/%b/%d %H:%M", "(%d %B, %Y) %H:%M"[1:].replace(")", "")])
        want.append(day)
        texts.append(day.strftime(form))
    assert read(spark, texts) == want


def test_unread_shapes_and_joined_tables(spark, monkeypatch):
    df = spark.createDataFrame([("2020.01.05", 1), ("soon", 2), ("later", 2), ("10.0.0.12", 3), ("10.0.0.13", 3), (None, 4),
                                ("2020.13.05", 5), ("2020-01-05", 6)], "`shape` string, `layout` long")
    assert [tuple(r) for r in DS.unread_shapes(df, "shape").collect()] == [(None, 2), ("99.9.9.99", 2)]
    small = sorted(map(str, DS.read_dates(df, "shape").collect()))
    monkeypatch.setattr(DS, "MAX_BROADCAST_SHAPES", 0)
    assert sorted(map(str, DS.read_dates(df, "shape").collect())) == small and len(small) == 8
    assert DS.read_dates(df.limit(0), "shape").count() == 0 == DS.unread_shapes(df.limit(0), "shape").count()
