import pytest

from sheetwise.functions import naming as N
from sheetwise.operators import profile as P


def test_stats_one_to_five(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 6)], "val long")
    r = P.compute_stats(df).first()
    assert (r["count"], r["mean"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]) == (5, 3, 1, 2, 3, 4, 5)
    assert r["std"] == pytest.approx(1.581)
    assert P.compute_stats(spark.createDataFrame([("a",)], "s string")) is None


def test_correlations_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.5, 5.0)], "a double, b double, c double")
    r = {(x["x"], x["y"]): x["r"] for x in P.correlations(df).collect()}
    assert r[("a", "b")] == r[("b", "a")] == 1.0 and r[("a", "c")] is None and len(r) == 9


def test_histogram_and_box(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(1000.0,)], "x double")
    h = P.histogram(df, "x", 10).collect()
    assert len(h) == 10 and sum(r["count"] for r in h) == 101
    b = P.box_summary(df, "x").first()
    assert b["outliers"] == 1 and b["whisker_high"] == 99.0


def test_category_breakdown_and_samples(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "c string")
    assert [tuple(r) for r in P.category_breakdown(df, "c").collect()] == [("a", 2), ("b", 1)]
    s = P.sample_values(df, 3).collect()
    assert [r["value"] for r in s] == ["a", "b"]


def test_roles(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(100)], "invoice_id long, revenue double")
    assert P.suggest_roles(df)["metric"] == "revenue"
    df2 = spark.createDataFrame([(i % 2 == 0, f"type{i % 3}", i % 5) for i in range(30)],
                                "is_holiday boolean, store_type string, sales long")
    roles = P.suggest_roles(df2)
    assert roles["category"] == "store_type" and roles["metric"] == "sales" and roles["binary"] == ["is_holiday"]


def test_names():
    assert N.name_tokens("StockCode") == ["stock", "code"]
    assert N.is_rate_like("Fuel_Price") and not N.is_rate_like("Weekly_Sales")
    assert N.humanize("fuelPrice") == "Fuel Price" and N.humanize("weekly_sales") == "Weekly Sales"
    assert N.pick_forecast_metric(["a", "revenue"], {}, "forecast revenue next month") == "revenue"


def test_quality_and_recommendations(spark):
    rep = spark.createDataFrame([(100, 4, 50, 20)], "original_rows long, original_cols int, total_missing long, duplicates_removed long")
    s = P.quality_scores(rep).first()
    assert (s["completeness"], s["duplicate_rate"]) == (87.5, 20.0)
    recs = {r["title"]: r["severity"] for r in P.recommendations(P.quality_scores(rep)).collect()}
    assert recs == {"Missing data detected": "Medium", "Duplicate rows found": "High"}
    ok = spark.createDataFrame([(100, 4, 0, 0)], "original_rows long, original_cols int, total_missing long, duplicates_removed long")
    assert [r["severity"] for r in P.recommendations(P.quality_scores(ok)).collect()] == ["Low"]


def test_exact_quantiles_brackets_match_numpy(spark):
    import numpy as np

    from sheetwise.functions.quantiles import exact_quantiles
    vals = [float((i * 7919) % 1000) / 7.0 for i in range(5000)] + [0.0] * 3000  # many ties
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = exact_quantiles(df, ["x"], [0.05, 0.25, 0.5, 0.9], accuracy=100, max_bracket=50)["x"]
    want = [float(np.percentile(vals, p)) for p in (5, 25, 50, 90)]
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_grouped_quantiles_brackets_match_percentile(spark):
    from pyspark.sql import functions as F

    from sheetwise.functions.quantiles import grouped_quantiles
    rows = [("hot" if i % 3 == 0 else f"g{i % 4}", float((i * 7919) % 1013) / 3.0) for i in range(6000)]
    rows += [("hot", 0.0)] * 500  # ties
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: (r["q0"], r["q1"], r["q2"])
           for r in grouped_quantiles(df, ["k"], "x", [0.05, 0.5, 0.9], sketch_accuracy=100).collect()}
    want = {r["k"]: tuple(r["p"]) for r in df.groupBy("k").agg(
        F.percentile("x", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.9))).alias("p")).collect()}
    assert set(got) == set(want)
    for k in want:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[k], want[k])), (k, got[k], want[k])


def test_exact_quantiles_settle_from_any_sketch(spark):
    import numpy as np

    from sheetwise.functions.quantiles import exact_quantiles
    vals = [((i * 7919) % 20011) / 3.0 for i in range(20000)] + [float("nan"), None]
    df = spark.createDataFrame([(v, 1.0) for v in vals], "x double, y double")
    got = exact_quantiles(df, ["x", "y"], [0.0, 0.37, 1.0], accuracy=20, max_bracket=20)
    want = np.percentile([v for v in vals if v is not None and v == v], [0, 37, 100])
    assert np.allclose(got["x"], want) and got["y"] == [1.0, 1.0, 1.0]


def test_all_columns_take_part(spark):
    df = spark.createDataFrame([tuple(float(i * j % 7) for j in range(30)) for i in range(20)],
                               ", ".join(f"c{j} double" for j in range(30)))
    assert P.numeric_profile(df).count() == 30
    assert P.correlations(df).count() == 900


def test_sample_values_of_every_type(spark):
    df = spark.sql("SELECT * FROM VALUES (3, 'b', true, 2.5D, DATE'2020-01-02'), (1, 'a', false, double('NaN'), NULL), "
                   "(2, 'b', true, -1.0D, DATE'2020-01-01'), (1, NULL, NULL, 7.0D, NULL) AS t(n, s, f, d, w)").repartition(3)
    got = {}
    for r in P.sample_values(df, 2).collect():
        got.setdefault(r["column"], {})[r["rank"]] = r["value"]
    assert got == {"n": {1: "1", 2: "2"}, "s": {1: "a", 2: "b"}, "f": {1: "false", 2: "true"},
                   "d": {1: "-1.0", 2: "2.5"}, "w": {1: "2020-01-01", 2: "2020-01-02"}}
    assert P.sample_values(df.limit(0)).count() == 0


def test_correlations_of_many_columns_in_two_scans(spark):
    import numpy as np
    import pandas as pd

    from sheetwise.operators import profile as P
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 150)) @ rng.normal(size=(150, 150)) * 100 + 1e6
    for missing in (False, True):
        frame = pd.DataFrame(base, columns=[f"c {i}" for i in range(150)])
        frame["c 7"] = 0.1
        frame["c 9"] = -2 * frame["c 3"]
        if missing:
            frame = frame.mask(rng.random(frame.shape) < 0.1)
            frame["c 11"] = np.where(frame["c 12"].isna(), 1.0 * np.arange(400), np.nan)  # nothing in common with c 12
        df = spark.createDataFrame(frame).repartition(5)
        got = P.correlations(df, digits=None).toPandas().pivot(index="x", columns="y", values="r")
        want = frame.corr()
        got = got.loc[want.index, want.columns].astype(float)
        assert np.allclose(got, want, atol=1e-9, equal_nan=True)
    assert P.correlations(df.limit(0)).where("r IS NOT NULL").count() == 0
