"""Joint restarts against the library's k-means."""

import numpy as np

from sheetwise.operators.kmeans import joint_kmeans, nearest


def test_best_cost_is_the_librarys(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(5, 3)) * 10
    x = np.concatenate([m + rng.normal(size=(60, 3)) for m in middles])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "key long, a double, `b b` double, c double").repartition(3)
    cols = ["a", "b b", "c"]
    centres, cost = joint_kmeans(df, "key", cols, 5)
    vec = VectorAssembler(inputCols=cols, outputCol="f").transform(df).cache()
    best = min(KMeans(k=5, seed=s, featuresCol="f").fit(vec).summary.trainingCost for s in range(10))
    assert cost <= best * 1.0001
    got = df.select("key", nearest(cols, centres).alias("n")).toPandas().sort_values("key")["n"].to_numpy()
    want = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (got == want.argmin(axis=1)).all() and np.isclose(want.min(axis=1).sum(), cost)
    again, same = joint_kmeans(df.repartition(7), "key", cols, 5)
    assert np.allclose(again, centres) and np.isclose(same, cost)


def test_fewer_different_rows_than_clusters(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(10)], "key long, a double")
    centres, cost = joint_kmeans(df, "key", ["a"], 4, n_init=3)
    assert cost == 0 and set(centres.ravel()) == {0.0, 1.0}
