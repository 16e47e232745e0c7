import pytest
from pyspark.sql import functions as F

from sheetwise.operators import anomaly as AN
from sheetwise.operators import ml as ML


def test_isolation_forest_flags_outlier(spark):
    vals = [10, 11, 9, 10, 12, 11, 10, 9, 500]
    df = spark.createDataFrame([(v,) for v in vals], "val long")
    out, summary = AN.detect_anomalies(df, contamination=0.05)
    flagged = {r["val"] for r in out.where("_anomaly").collect()}
    assert flagged == {500}
    s = summary.first()
    assert s["total_anomalies"] == 1 and s["cols_used"] == ["val"]
    worst = AN.strangest_rows(out, 1).first()
    assert worst["val"] == 500


def test_no_numeric_columns_unchanged(spark):
    df = spark.createDataFrame([("a",), ("b",)], "s string")
    out, summary = AN.detect_anomalies(df)
    assert summary is None and out.columns == ["s"]


def test_segments(spark):
    rows = [(f"p{i}", 1000.0 + i, 10.0 + i) for i in range(5)] + [(f"q{i}", 10.0 + i, 1000.0 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "product string, revenue double, units double")
    res = ML.segment_categories(df, "product", ["revenue", "units"], n_clusters=2, n_init=2)
    seg = {r["product"]: r["segment"] for r in res["segments"].collect()}
    assert {seg[f"p{i}"] for i in range(5)} == {0} and {seg[f"q{i}"] for i in range(5)} == {1}
    with pytest.raises(ValueError):
        ML.segment_categories(df.where(F.col("product") == "p0"), "product", ["revenue"])


def test_outcome_risk(spark):
    rows = [(float(i), "yes" if i >= 30 else "no") for i in range(60)]
    df = spark.createDataFrame(rows, "risk_feature double, readmitted string")
    res = ML.binary_outcome_risk_model(df, "readmitted", ["risk_feature"])
    assert res["positive_class"] == "yes" and 0.0 <= res["accuracy"] <= 1.0 and res["accuracy"] > 0.8
    scores = [r["risk_score"] for r in res["scored"].collect()]
    assert scores == sorted(scores, reverse=True)
    with pytest.raises(ValueError):
        ML.binary_outcome_risk_model(df.limit(10), "readmitted", ["risk_feature"])


def test_samples(spark):
    df = spark.range(10000).withColumn("_anomaly", (F.col("id") % 500) == 0)
    s1, sampled = ML.sample_for_chart(df, 2000)
    assert sampled and s1.count() == 2000
    assert sorted(r[0] for r in s1.select("id").collect()) == sorted(r[0] for r in ML.sample_for_chart(df, 2000)[0].select("id").collect())
    s2, _ = ML.sample_for_chart_preserving_flag(df, "_anomaly", 2000)
    assert s2.count() == 2000 and s2.where("_anomaly").count() == 20
    small, flag = ML.sample_for_chart(df.limit(10), 2000)
    assert not flag and small.count() == 10


def test_forest_scores_match_direct_evaluation(spark):
    """Brute force: the distributed scoring UDF and cut agree with evaluating the same forest
    directly in NumPy on the collected rows."""
    import numpy as np

    rows = [(float(i % 13), float((i * 7) % 11)) for i in range(300)] + [(90.0, 90.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    trees, psi = AN.fit_forest(df, ["a", "b"], n_trees=20, psi=64, seed=7, n_rows=len(rows))
    c = AN.average_path(psi)
    x = np.array(rows)
    direct = -np.power(2.0, -AN._path_lengths(x, trees) / c)
    udf = AN.score_column(["a", "b"], trees, psi, {"a": 0.0, "b": 0.0})
    got = [r[0] for r in df.select(udf("a", "b")).collect()]
    assert np.allclose(sorted(got), sorted(direct))
    assert AN.low_quantile(df.select(udf("a", "b").alias("s")), "s", 0.05, len(rows)) == pytest.approx(np.percentile(direct, 5))
    assert min(got) == pytest.approx(direct[-1])  # the far point is the strangest


def test_logistic_penalty_matches_direct_newton_solve(spark):
    """Brute force: with every row in training, the coefficients equal a NumPy Newton solve of
    0.5 |w|^2 + C * sum(log-loss) on population-standardised features (intercept unpenalised)."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) * [3.0, 0.5] + [10.0, -2.0]
    logits = 0.8 * (x[:, 0] - 10) / 3 - 1.2 * (x[:, 1] + 2) / 0.5
    y = (rng.random(200) < 1 / (1 + np.exp(-logits))).astype(int)
    rows = [(float(a), float(b), "yes" if t else "no") for (a, b), t in zip(x, y)]
    df = spark.createDataFrame(rows, "f1 double, f2 double, outcome string")
    res = ML.binary_outcome_risk_model(df, "outcome", ["f1", "f2"], C=1.0, test_fraction=0.0)
    got = {r["feature"]: r["weight"] for r in res["feature_importances"].collect()}

    z = (x - x.mean(axis=0)) / x.std(axis=0)
    a = np.column_stack([np.ones(len(z)), z])
    w = np.zeros(3)
    reg = np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        grad = a.T @ (p - y) + reg @ w
        hess = a.T @ (a * (p * (1 - p))[:, None]) + reg
        w -= np.linalg.solve(hess, grad)
    assert got["f1"] == pytest.approx(round(w[1], 4), abs=2e-4)
    assert got["f2"] == pytest.approx(round(w[2], 4), abs=2e-4)


def test_random_rows_do_not_depend_on_values(spark):
    from sheetwise.operators.topk import random_rows
    df = spark.range(40000, numPartitions=4).select((F.col("id") % 4).alias("v"))
    rows = random_rows(df, 2000, 40000, 42)
    counts = [r["count"] for r in rows.groupBy("v").count().collect()]
    assert sum(counts) == 2000 and len(counts) == 4 and min(counts) > 400  # equal rows are drawn one by one
    assert random_rows(df, 50000, 40000, 1).count() == 40000


def test_forest_learns_from_frequent_values(spark):
    df = spark.range(60000, numPartitions=4).select(
        F.when(F.col("id") < 300, 500.0).otherwise((F.col("id") % 10).cast("double")).alias("v"))
    out, summary = AN.detect_anomalies(df, n_trees=50)
    flagged = out.where("_anomaly").groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in flagged}.get(500.0) == 300


def test_split_is_stratified_on_a_binary_feature(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("f"), F.when(F.col("id") % 2 == 1, "y").otherwise("n").alias("o"))
    for seed in (1, 5, 42):
        res = ML.binary_outcome_risk_model(df, "o", ["f"], seed=seed)
        assert res["accuracy"] == 1.0
        assert {(r["positive"], r["test"]): r["n"] for r in res["split"].collect()} == {
            (True, True): 125, (True, False): 375, (False, True): 125, (False, False): 375}


def test_samples_with_map_columns(spark):
    df = spark.range(3000).select("id", F.create_map(F.lit("k"), F.col("id") % 5).alias("m"))
    s, sampled = ML.sample_for_chart(df, 100)
    assert sampled and s.count() == 100


def test_rows_of_equal_scores_are_sorted_by_many_tasks(spark):
    rows = [(i % 2, "yes" if (i * 7) % 10 < 3 + 4 * (i % 2) else "no") for i in range(2000)]
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        scored = ML.binary_outcome_risk_model(spark.createDataFrame(rows, "x int, o string"), "o", ["x"])["scored"]
        assert scored.columns == ["o", "x", "risk_score"]
        parts = scored.rdd.glom().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert max(map(len, parts)) < 600  # two scores, a thousand rows each
    scores = [r["risk_score"] for p in parts for r in p]
    assert len(scores) == 2000 and scores == sorted(scores, reverse=True) and len(set(scores)) == 2


def test_outcome_values_are_counted_without_sorting_the_rows(spark, monkeypatch):
    def sorts(*_):
        raise AssertionError("a distinct count beside averages sorts every row")

    monkeypatch.setattr(ML.F, "count_distinct", sorts)
    rows = [(float(i), "yes" if i % 3 else "no") for i in range(60)] + [(1.0, None), (float("nan"), "maybe")]
    res = ML.binary_outcome_risk_model(spark.createDataFrame(rows, "x double, o string"), "o", ["x"])
    assert res["positive_class"] == "yes" and res["n_train"] == 45
    with pytest.raises(ValueError, match="0 different values"):
        ML.binary_outcome_risk_model(spark.createDataFrame([], "x double, o string"), "o", ["x"])
