import datetime as dt

import pytest
from pyspark.sql import functions as F

from sheetwise.operators import timeseries as TS
from sheetwise.operators.sequence import with_position


def days(n, start=dt.datetime(2021, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_forecast_slope_and_too_few(spark):
    df = spark.createDataFrame([(d, 100 + 5 * i) for i, d in enumerate(days(20))], "date timestamp, value long")
    res = TS.forecast(df, "date", "value", periods=7)
    meta = res["meta"].first()
    assert meta["slope"] == pytest.approx(5, abs=0.5) and meta["direction"] == "increasing"
    s = res["series"]
    assert s.where(F.col("type") == "Forecast").count() == 7 and s.where(F.col("type") == "Actual").count() == 20
    short = spark.createDataFrame([(d, 1) for d in days(3)], "date timestamp, value long")
    assert TS.forecast(short, "date", "value") is None


def test_forecast_irregular_uses_ranking(spark):
    ds = [d for i, d in enumerate(days(30)) if i % 4 != 3]
    df = spark.createDataFrame([(d, float(i)) for i, d in enumerate(ds)], "date timestamp, value double")
    res = TS.forecast(df, "date", "value", periods=5)
    assert res["meta"].first()["slope"] == pytest.approx(1.0)
    assert res["meta"].first()["freq"] == "D"


def test_trend_gaps_bad_dates_and_weeks(spark):
    df = spark.createDataFrame([("2021-01-01", 10), ("2021-01-01", 5), ("2021-01-03", 7), ("bad", 99)],
                               "date string, revenue long")
    rows = [(r["period"].date(), r["total"]) for r in TS.time_trend(df, "date", "revenue", "D").collect()]
    assert rows == [(dt.date(2021, 1, 1), 15.0), (dt.date(2021, 1, 2), 0.0), (dt.date(2021, 1, 3), 7.0)]
    w = TS.time_trend(df, "date", "revenue", "W").collect()
    assert [r["period"].date() for r in w] == [dt.date(2021, 1, 3)]  # Friday and Sunday: same week
    rate = spark.createDataFrame([("2021-01-01", 15.0), ("2021-01-03", 40.0)], "date string, price double")
    r = TS.time_trend(rate, "date", "price", "M").collect()
    assert [(x["period"].date(), x["total"]) for x in r] == [(dt.date(2021, 1, 31), 27.5)]


def test_control_chart(spark):
    df = spark.createDataFrame([(10.0, i) for i in range(20)] + [(50.0, 20)], "measurement double, run_order long")
    res = TS.control_chart(df, "measurement", "run_order")
    s = res["summary"].first()
    assert s["out_of_control_count"] == 1 and s["out_of_control_pct"] == pytest.approx(4.8)
    pts = res["points"].collect()
    assert [p["run_order"] for p in pts] == list(range(21)) and pts[-1]["in_control"] is False
    one = spark.createDataFrame([(5.0,)], "measurement double")
    assert TS.control_chart(one, "measurement")["summary"].first()["std"] == 0.0


def test_time_to_limit(spark):
    up = spark.createDataFrame([(10 + i, i) for i in range(11)], "measurement long, seq long")
    r = TS.time_to_limit(up, "measurement", ["seq"], ucl=30.0, lcl=0.0).first()
    assert r["trend"] == "increasing" and r["periods_to_breach"] == 10.0 and r["current_value"] == 20.0
    flat = spark.createDataFrame([(5, i) for i in range(6)], "measurement long, seq long")
    assert TS.time_to_limit(flat, "measurement", ["seq"], 10.0, 0.0).first()["trend"] == "stable"
    few = spark.createDataFrame([(5, i) for i in range(4)], "measurement long, seq long")
    with pytest.raises(ValueError):
        TS.time_to_limit(few, "measurement", ["seq"], 10.0, 0.0)


def test_with_position_matches_sort(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(200)], "k long, v long")
    rows = with_position(df, ["k", "v"], "t", partitions=5).collect()
    got = sorted((r["t"], r["k"], r["v"]) for r in rows)
    want = sorted(((x % 7), x) for x in range(200))
    assert [(k, v) for _, k, v in got] == want and [t for t, _, _ in got] == list(range(200))


def test_forecast_quarterly_and_business_day_frequencies(spark):
    import calendar
    qe = [dt.datetime(2020 + (3 * i) // 12, (3 * i) % 12 + 3, 1) for i in range(8)]
    qe = [d.replace(day=calendar.monthrange(d.year, d.month)[1]) for d in qe]  # quarter ends
    df = spark.createDataFrame([(d, float(10 * i)) for i, d in enumerate(qe)], "date timestamp, value double")
    res = TS.forecast(df, "date", "value", periods=2)
    assert res["meta"].first()["freq"] == "3ME"
    fut = [r["date"] for r in res["series"].where(F.col("type") == "Forecast").orderBy("date").collect()]
    assert fut == [dt.datetime(2022, 3, 31), dt.datetime(2022, 6, 30)]
    assert res["meta"].first()["slope"] == pytest.approx(10.0)

    bdays = [d for d in days(21, dt.datetime(2024, 1, 1)) if d.weekday() < 5]  # 15 weekdays
    df2 = spark.createDataFrame([(d, float(i)) for i, d in enumerate(bdays)], "date timestamp, value double")
    res2 = TS.forecast(df2, "date", "value", periods=3)
    assert res2["meta"].first()["freq"] == "B" and res2["meta"].first()["slope"] == pytest.approx(1.0)
    fut2 = [r["date"] for r in res2["series"].where(F.col("type") == "Forecast").orderBy("date").collect()]
    assert fut2 == [dt.datetime(2024, 1, 22), dt.datetime(2024, 1, 23), dt.datetime(2024, 1, 24)]
