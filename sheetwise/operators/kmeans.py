"""K-means with all its restarts advanced together.

Each pass over the rows serves every start: seeding draws the next centre of all starts, and an iteration
assigns the rows to the centres of all starts that still move, in Arrow batches, and adds up per (start,
cluster). A pass returns ``starts * k`` rows, so ten restarts cost the scans of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Keys and feature rows of a batch (key first)."""
    key = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return key, np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in batch.columns[1:]])


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for every key, repeatable."""
    x = key ^ np.uint64((salt * 0x9E3779B97F4A7C15 + 0xD1B54A32D192ED03) % 2 ** 64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2 ** 53 + 2.0 ** -54


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every centre."""
    out = np.empty((len(x), len(centres)))
    for j, c in enumerate(centres):
        out[:, j] = ((x - c) ** 2).sum(axis=1)
    return out


def _seeds(rows: DataFrame, d: int, k: int, n_init: int, seed: int) -> np.ndarray:
    """Centres (start, cluster, feature) by k-means++: the next centre of every start is drawn with
    weights of squared distances, by the smallest of exponential variates, one pass for all starts."""
    centres = np.zeros((n_init, 0, d))
    for step in range(k):
        def draw(batches: Iterator[pa.RecordBatch], centres=centres, step=step) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[float, list[float]]] = {}
            for batch in batches:
                key, x = _matrix(batch)
                for s in range(n_init):
                    w = _distances(x, centres[s]).min(axis=1) if step else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        wait = np.where(w > 0, -np.log(_uniform(key, (seed * 1000 + s) * 1000 + step)) / w, np.inf)
                    i = int(wait.argmin()) if len(wait) else 0
                    if len(wait) and wait[i] < best.get(s, (np.inf,))[0]:
                        best[s] = (float(wait[i]), x[i].tolist())
            if best:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(best), pa.int32()), pa.array([b[0] for b in best.values()]),
                     pa.array([b[1] for b in best.values()], pa.list_(pa.float64()))], names=["s", "wait", "centre"])

        drawn = (rows.mapInArrow(draw, "s int, wait double, centre array<double>")
                 .groupBy("s").agg(F.min_by("centre", F.struct("wait", "centre")).alias("centre")).collect())
        # where every row is a centre already, the first centre again
        found = {r["s"]: np.array(r["centre"]) for r in drawn}
        new = np.stack([found[s] if s in found else centres[s, 0] for s in range(n_init)])
        centres = np.concatenate([centres, new[:, None, :]], axis=1)
    return centres


def _pass(rows: DataFrame, centres: np.ndarray, starts: list[int]) -> list:
    """Per (start, cluster): rows, cost and sums of the features."""
    d = centres.shape[2]
    sums = [f"t{j}" for j in range(d)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = centres.shape[1]
        total = np.zeros((len(starts), k, d + 2))
        for batch in batches:
            _, x = _matrix(batch)
            for i, s in enumerate(starts):
                dist = _distances(x, centres[s])
                near = dist.argmin(axis=1)
                total[i, :, 0] += np.bincount(near, minlength=k)
                total[i, :, 1] += np.bincount(near, weights=dist[np.arange(len(x)), near], minlength=k)
                for j in range(d):
                    total[i, :, 2 + j] += np.bincount(near, weights=x[:, j], minlength=k)
        at = [(s, c) for s in starts for c in range(k)]
        flat = total.reshape(-1, d + 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a[0] for a in at], pa.int32()), pa.array([a[1] for a in at], pa.int32()),
             *[pa.array(flat[:, j]) for j in range(d + 2)]], names=["s", "c", "n", "cost", *sums])

    schema = "s int, c int, n double, cost double, " + ", ".join(f"{t} double" for t in sums)
    return (rows.mapInArrow(assign, schema).groupBy("s", "c")
            .agg(*[F.sum(c).alias(c) for c in ("n", "cost", *sums)]).collect())


def joint_kmeans(rows: DataFrame, key: str, features: list[str], k: int, n_init: int = 10, seed: int = 42,
                 max_iter: int = 300, tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """The centres (k by features) and the cost of the best of ``n_init`` starts. ``key`` is a LONG that
    differs from row to row (equal keys draw alike). A start rests when none of its centres moves by more than ``tol``;
    of equal costs the lower start wins. A cluster without rows keeps its centre."""
    data = rows.select(F.col(f"`{key}`"), *[F.col(f"`{f}`").cast("double") for f in features])
    centres = _seeds(data, len(features), k, n_init, seed)
    moving = list(range(n_init))
    for _ in range(max_iter):
        new = centres.copy()
        for r in _pass(data, centres, moving):
            if r["n"]:
                new[r["s"], r["c"]] = np.array(r[4:]) / r["n"]
        moving = [s for s in moving if (((new[s] - centres[s]) ** 2).sum(axis=1) > tol ** 2).any()]
        centres = new
        if not moving:
            break
    cost = np.zeros(n_init)
    for r in _pass(data, centres, list(range(n_init))):
        cost[r["s"]] += r["cost"]
    best = int(cost.argmin())
    return centres[best], float(cost[best])


def nearest(features: list[str], centres: np.ndarray) -> Column:
    """The number of the centre nearest to a row (of equal ones the first)."""
    far = F.array(*[sum(((F.col(f"`{f}`") - F.lit(float(v))) * (F.col(f"`{f}`") - F.lit(float(v)))
                         for f, v in zip(features, c, strict=True)), F.lit(0.0)) for c in centres])
    return (F.array_position(far, F.array_min(far)) - 1).cast("int")
