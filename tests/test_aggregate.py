import pytest

from sheetwise.operators import aggregate as G


def test_top_performers_sum_and_share(spark):
    df = spark.createDataFrame([("A", 150), ("A", 50), ("B", 100), ("C", 10), (None, 999)],
                               "product string, revenue long")
    rows = G.top_performers(df, "product", "revenue").collect()
    assert [(r["product"], r["total"]) for r in rows] == [("A", 200.0), ("B", 100.0), ("C", 10.0)]
    assert [r["share_pct"] for r in rows] == [64.5, 32.3, 3.2]


def test_top_performers_rate_like_is_mean(spark):
    df = spark.createDataFrame([("s1", 3.0), ("s1", 5.0), ("s2", 10.0)], "store string, fuel_price double")
    rows = {r["store"]: r["total"] for r in G.top_performers(df, "store", "fuel_price").collect()}
    assert rows == {"s1": 4.0, "s2": 10.0}


def test_top_performers_top_n_ties_by_key(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 1)], "k string, amount long")
    assert [r["k"] for r in G.top_performers(df, "k", "amount", 2).collect()] == ["a", "b"]


def test_top_performers_zero_total_gives_zero_share(spark):
    df = spark.createDataFrame([("a", 0), ("b", 0)], "k string, amount long")
    assert {r["share_pct"] for r in G.top_performers(df, "k", "amount").collect()} == {0.0}


def test_missing_column_raises(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v long")
    with pytest.raises(ValueError):
        G.top_performers(df, "k", "nope")


def test_concentration_single_and_equal(spark):
    one = spark.createDataFrame([("acc1", 100), ("acc1", 50)], "account string, balance long")
    s = G.concentration_risk(one, "account", "balance")["summary"].first()
    assert s["hhi"] == 1.0 and s["risk_level"] == "High" and s["top_category_share_pct"] == 100.0
    ten = spark.createDataFrame([(f"a{i}", 10) for i in range(10)], "account string, balance long")
    res = G.concentration_risk(ten, "account", "balance")
    s = res["summary"].first()
    assert s["hhi"] == pytest.approx(0.1) and s["risk_level"] == "Low"
    assert sum(r["share"] for r in res["breakdown"].collect()) == pytest.approx(1.0)


def test_kpi_summary_sum_and_mean(spark):
    df = spark.createDataFrame([("ER", 30), ("ICU", 50)], "department string, patients long")
    k = G.kpi_summary(df, "department", "patients").first()
    assert k["total"] == 80.0 and k["category_count"] == 2 and k["top_category"] == "ICU"
    assert k["top_category_share_pct"] == 62.5 and k["avg_per_category"] == 40.0 and k["agg"] == "sum"
    df2 = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 6.0), (None, 7.0)], "store string, fuel_price double")
    k2 = G.kpi_summary(df2, "store", "fuel_price").first()
    assert k2["agg"] == "mean" and k2["total"] == 4.0 and k2["category_count"] == 2


def test_chart_aggregate_top_n_and_refusal(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 10.0), ("c", "x", 5.0),
                                (None, "x", 100.0)], "cat string, color string, amount double")
    out = G.chart_aggregate(df, "cat", "amount", color="color", agg="sum", top_n=2).collect()
    assert sorted((r["cat"], r["color"], r["amount"]) for r in out) == [("b", "x", 10.0), ("c", "x", 5.0)]
    med = {r["cat"]: r["amount"] for r in G.chart_aggregate(df, "cat", "amount", agg="median").collect()}
    assert med["a"] == 1.5
    with pytest.raises(ValueError):
        G.chart_aggregate(df, "amount", "amount")
