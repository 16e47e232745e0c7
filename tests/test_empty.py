"""Empty inputs: operators return empty or neutral results instead of failing."""
from sheetwise.operators import aggregate as G
from sheetwise.operators import anomaly as AN
from sheetwise.operators import clean as C
from sheetwise.operators import profile as P
from sheetwise.operators import timeseries as TS


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "cat string, amount double, d timestamp, seq long")
    assert G.top_performers(df, "cat", "amount").count() == 0
    assert G.concentration_risk(df, "cat", "amount")["summary"].first()["hhi"] == 0.0
    assert TS.time_trend(df, "d", "amount").count() == 0
    assert TS.forecast(df, "d", "amount") is None
    assert TS.control_chart(df, "amount")["summary"].first()["out_of_control_count"] == 0
    assert P.category_breakdown(df, "cat").count() == 0
    assert P.histogram(df, "amount").count() == 0
    stats = P.compute_stats(df).collect()
    assert {r["column"] for r in stats} == {"amount", "seq"} and all(r["count"] == 0 for r in stats)
    cleaned, _, rep = C.clean(df)
    assert cleaned.count() == 0 and rep["original_rows"] == 0
    out, summary = AN.detect_anomalies(df)
    assert out.count() == 0 and summary.first()["total_anomalies"] == 0
