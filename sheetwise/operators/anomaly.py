"""A1 isolation forest and A2 anomalous-row views.

``pyspark.ml`` has no isolation forest, so it is built from Spark pieces (Liu, Ting & Zhou 2008):

* training rows drawn at random whatever their values (:func:`random_rows`): ``n_trees * psi`` rows
  dealt out to the trees (tables with fewer rows: every tree draws its own ``psi`` of them);
* trees grown per tree group with ``groupBy(tree).applyInPandas`` (at most ``psi`` rows each);
* the forest (at most ``n_trees * (2 psi - 1)`` nodes, a proven bound) is collected once and
  shipped with a vectorised pandas UDF that scores Arrow batches of the feature columns only;
* rows are scored in one pass and kept with their scores in the checkpoint folder, which everything
  after reads; the cut is the ``contamination`` quantile of the scores - exact, by radix selection -
  and a row is flagged when its score is below it.

Splits are uniform between a node's minimum and maximum, so the forest does not depend on
per-column affine scaling; the reference's standardisation step is therefore not needed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions import naming as N
from sheetwise.functions.quantiles import exact_quantiles, quantile
from sheetwise.operators.topk import random_rows
from sheetwise.session import written

EULER = 0.5772156649015329
NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, "
               "leaf_depth double")


def average_path(n: float) -> float:
    """c(n): average path length of an unsuccessful search in a binary search tree of n keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    """One isolation tree over the rows of ``x``; returns parallel node lists."""
    feature, threshold, left, right, leaf = [], [], [], [], []

    def new_node():
        feature.append(-1), threshold.append(0.0), left.append(-1), right.append(-1), leaf.append(0.0)
        return len(feature) - 1

    stack = [(new_node(), np.arange(len(x)), 0)]
    while stack:
        node, idx, depth = stack.pop()
        if depth >= max_depth or len(idx) <= 1:
            leaf[node] = depth + average_path(len(idx))
            continue
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if len(usable) == 0:
            leaf[node] = depth + average_path(len(idx))
            continue
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < t
        lnode, rnode = new_node(), new_node()
        feature[node], threshold[node], left[node], right[node] = f, t, lnode, rnode
        stack.append((lnode, idx[go_left], depth + 1))
        stack.append((rnode, idx[~go_left], depth + 1))
    return feature, threshold, left, right, leaf


def _tree_builder(cols: list[str], psi: int, seed: int):
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf[cols].to_numpy(dtype="float64")
        rng = np.random.default_rng([seed, tree])
        f, t, lft, rgt, leaf = _grow(x, rng, max_depth)
        return pd.DataFrame({"tree": tree, "node": np.arange(len(f), dtype="int32"),
                             "feature": np.asarray(f, dtype="int32"), "threshold": t,
                             "left": np.asarray(lft, dtype="int32"), "right": np.asarray(rgt, dtype="int32"),
                             "leaf_depth": leaf})
    return build


def _forest_arrays(nodes: pd.DataFrame):
    """All trees in one set of node arrays; child links become global node ids."""
    nodes = nodes.sort_values(["tree", "node"])
    sizes = nodes.groupby("tree")["node"].count().to_numpy()
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    tree_off = np.repeat(offsets, sizes)
    left = nodes["left"].to_numpy().astype(np.int64)
    right = nodes["right"].to_numpy().astype(np.int64)
    return {"roots": offsets,
            "feature": nodes["feature"].to_numpy().astype(np.int64),
            "threshold": nodes["threshold"].to_numpy(),
            "left": np.where(left >= 0, left + tree_off, -1),
            "right": np.where(right >= 0, right + tree_off, -1),
            "leaf_depth": nodes["leaf_depth"].to_numpy()}


def _path_lengths(x: np.ndarray, forest) -> np.ndarray:
    """Mean path length of every row over all trees. Per tree, the rows still at inner nodes
    descend one level per step (the active set shrinks as rows reach leaves)."""
    n = len(x)
    total = np.zeros(n)
    rows = np.arange(n)
    feature, threshold = forest["feature"], forest["threshold"]
    left, right, leaf_depth = forest["left"], forest["right"], forest["leaf_depth"]
    for root in forest["roots"]:
        node = np.full(n, root, dtype=np.int64)
        active = rows
        while len(active):
            f = feature[node[active]]
            inner = f >= 0
            active, f = active[inner], f[inner]
            if not len(active):
                break
            nd = node[active]
            go_left = x[active, f] < threshold[nd]
            node[active] = np.where(go_left, left[nd], right[nd])
        total += leaf_depth[node]
    return total / max(len(forest["roots"]), 1)


def training_sample(df: DataFrame, cols: list[str], n_rows: int, n_trees: int, psi: int,
                    seed: int) -> DataFrame:
    """``tree`` + feature columns: ``psi`` rows per tree, drawn without replacement and without
    regard to their values, so that frequent values are drawn as often as they occur."""
    feats = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    if n_rows >= n_trees * psi:
        top = random_rows(feats, n_trees * psi, n_rows, seed)
        # the sample has n_trees * psi rows: a bounded single-partition window
        turn = F.row_number().over(Window.orderBy("_u")) - 1
        return top.withColumn("tree", (turn % n_trees).cast("int")).drop("_u")
    # fewer rows than the trees need together: each tree draws from all of them (at most
    # n_trees * n_trees * psi rows here)
    drawn = (feats.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))))
             .withColumn("_u", F.rand(seed)).checkpoint())
    w = Window.partitionBy("tree").orderBy("_u")
    return drawn.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi).drop("_r", "_u")


def fit_forest(df: DataFrame, cols: list[str], n_trees: int = 100, psi: int = 256, seed: int = 42,
               n_rows: int | None = None):
    n_rows = n_rows if n_rows is not None else df.count()
    psi = min(psi, max(n_rows, 1))
    sample = training_sample(df, cols, n_rows, n_trees, psi, seed)
    nodes = (sample.groupBy("tree")
                   .applyInPandas(_tree_builder(cols, psi, seed), NODE_SCHEMA)
                   .toPandas())  # at most n_trees * (2 psi - 1) rows
    return _forest_arrays(nodes), psi


def score_column(cols: list[str], trees, psi: int, fill: dict[str, float]):
    """A pandas UDF: sklearn-style ``score_samples`` (-2^(-E[h]/c(psi)); lower is stranger)."""
    forest = trees
    c = average_path(psi) or 1.0
    fills = np.array([fill.get(k, 0.0) for k in cols], dtype="float64")

    @F.pandas_udf("double")
    def score(*series: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype="float64", na_value=np.nan) for s in series])
        nan = np.isnan(x)
        if nan.any():
            x = np.where(nan, fills[None, :], x)
        return pd.Series(-np.power(2.0, -_path_lengths(x, forest) / c))

    return score


def detect_anomalies(df: DataFrame, contamination: float = 0.05, n_trees: int = 100,
                     psi: int = 256, seed: int = 42, accuracy="auto",
                     cols: list[str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """A1: ``df`` plus ``_anomaly`` (boolean) and ``_anomaly_score`` (lower is stranger), and a
    one-row summary ``total_anomalies, anomaly_pct (round 1), cols_used``. All numeric,
    non-internal columns are used; with none, ``df`` comes back unchanged and summary ``None``.
    NULL feature values are scored at the column mean. The scored rows are written to the checkpoint
    folder: scoring runs once, whatever reads the result."""
    cols = cols or N.numeric_columns(df)
    if not cols:
        return df, None
    stats = df.agg(F.count("*").alias("n"), *[F.avg(F.col(f"`{c}`")).alias(f"m{i}")
                                             for i, c in enumerate(cols)]).first()
    n = stats["n"]
    if n == 0:  # nothing to learn from: the flag columns exist, every count is 0
        out = df.withColumn("_anomaly", F.lit(False)).withColumn("_anomaly_score", F.lit(None).cast("double"))
        summary = df.sparkSession.createDataFrame([(0, 0.0, list(cols))],
                                                  "total_anomalies long, anomaly_pct double, cols_used array<string>")
        return out, summary
    fill = {c: float(stats[f"m{i}"]) if stats[f"m{i}"] is not None else 0.0 for i, c in enumerate(cols)}
    trees, psi_eff = fit_forest(df, cols, n_trees, psi, seed, n)
    score = score_column(cols, trees, psi_eff, fill)
    # scored once: rows and scores are kept, and cut, flags, samples and top-k all read them
    scored = written(df.withColumn("_anomaly_score", score(*[F.col(f"`{c}`").cast("double") for c in cols])), "scored")
    cut = low_quantile(scored.select("_anomaly_score"), "_anomaly_score", contamination, n, accuracy)
    out = scored.withColumn("_anomaly", F.col("_anomaly_score") < F.lit(cut))
    cols_order = [c for c in df.columns] + ["_anomaly", "_anomaly_score"]
    out = out.select(*[F.col(f"`{c}`") for c in cols_order])
    summary = (out.agg(F.count_if("_anomaly").alias("total_anomalies"), F.count("*").alias("_n"))
                  .select("total_anomalies",
                          F.when(F.col("_n") > 0, F.bround(F.col("total_anomalies") / F.col("_n") * 100, 1))
                           .otherwise(F.lit(0.0)).alias("anomaly_pct"),
                          F.array(*[F.lit(c) for c in cols]).alias("cols_used")))
    return out, summary


def low_quantile(df: DataFrame, col: str, q: float, n: int, accuracy="auto") -> float | None:
    """The ``q`` quantile (linear interpolation, as NumPy) of ``col``, exact with bounded memory
    (:func:`exact_quantiles`: radix selection, no top-k funnel into one task); an int
    ``accuracy`` gives the sketch's value."""
    if n == 0:
        return None
    if isinstance(accuracy, int) and not isinstance(accuracy, bool):
        return df.agg(quantile(col, q, accuracy).alias("q")).first()["q"]
    return exact_quantiles(df, [col], [q])[col][0]


def anomalous_rows(df: DataFrame) -> DataFrame:
    """A2: the flagged rows with the internal columns dropped."""
    return df.where(F.col("_anomaly")).drop("_anomaly", "_anomaly_score")


def strangest_rows(df: DataFrame, n: int = 20) -> DataFrame:
    """A2 (finance view): the ``n`` lowest scores (a top-k, each task keeps ``n`` rows)."""
    return df.orderBy(F.col("_anomaly_score").asc()).limit(n).drop("_anomaly")
