"""Hot keys: one key holding a third (or all) of the rows must not change results."""
from pyspark.sql import functions as F

from sheetwise.operators import aggregate as G
from sheetwise.operators import clean as C
from sheetwise.operators import profile as P
from sheetwise.operators.sequence import with_position


def skewed(spark, n=3000):
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", float(i % 97), i) for i in range(n)]
    return spark.createDataFrame(rows, "k string, v double, id long")


def test_grouped_results_with_hot_key(spark):
    df = skewed(spark)
    top = {r["k"]: r["total"] for r in G.top_performers(df, "k", "v", 3).collect()}
    want = df.groupBy("k").agg(F.sum("v").alias("s")).orderBy(F.col("s").desc(), "k").limit(3).collect()
    assert top == {r["k"]: r["s"] for r in want}
    box = {r["k"]: r for r in P.box_summary(df, "v", by="k").collect()}
    assert box["hot"]["n"] == 1000


def test_position_with_one_key_everywhere(spark):
    df = spark.createDataFrame([(1, i % 17) for i in range(2000)], "k long, v long")
    rows = with_position(df, ["k", "v"], "t", partitions=8).collect()
    ts = sorted(r["t"] for r in rows)
    assert ts == list(range(2000))
    by_t = sorted((r["t"], r["v"]) for r in rows)
    assert [v for _, v in by_t] == sorted(i % 17 for i in range(2000))


def test_modes_and_duplicates_with_hot_value(spark):
    rows = [("a", None)] * 1500 + [("b", "x"), ("c", "y"), ("c", "y"), ("d", None)]
    df = spark.createDataFrame(rows, "g string, t string")
    cleaned, _, rep = C.clean(df)
    assert rep["duplicates_removed"] == 1500 and cleaned.count() == 4
    assert {r["t"] for r in cleaned.collect()} == {"x", "y"}  # mode of the kept rows ("x" < "y" on ties)
