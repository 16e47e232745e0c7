"""Exact quantiles with bounded memory, one method for every table size.

Spark's exact ``percentile`` keeps a value->count map per group, which cannot fit in one task for
billions of distinct values. Whole-table quantiles of any number of columns come from a radix selection
over the values' bits; per-group ones from a sketch that only *proposes* a bracket around the
wanted rank, while counts of the rows below and inside it decide. Either way the order statistics are
read from value counts inside a settled bracket. ``percentile_approx`` values are returned only when a
caller asks for an accuracy.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile(col: Column | str, probs, accuracy: int | None = None) -> Column:
    """Quantile(s) of ``col`` with linear interpolation (exact, ``accuracy=None``) or from the
    approximate sketch (``accuracy`` given). ``probs`` may be a float or a list."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(probs, (list, tuple)):
        if accuracy:
            return F.percentile_approx(c.cast("double"), list(probs), accuracy)
        return F.percentile(c.cast("double"), F.array(*[F.lit(float(p)) for p in probs]))
    if accuracy:
        return F.percentile_approx(c.cast("double"), float(probs), accuracy).cast("double")
    return F.percentile(c.cast("double"), F.lit(float(probs))).cast("double")


#: Bits of the values' image that the passes of the radix selection tell apart: the first covers sign,
#: exponent and a sixteenth of an octave; later ones are narrower, since every task returns a histogram for
#: each bracket (4,096 counters are a few percent of the task's rows; 65,536 could be as many).
RADIX_BITS = (16, 12, 12, 12, 12)
#: Columns whose first histograms (512 KB each) a task holds at a time.
COLUMNS_AT_ONCE = 200
_SIGN = 1 << 63


def order_image(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit integers in the order of the doubles ``x`` (no NaN; -0.0 and 0.0 are equal)."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >= np.uint64(_SIGN), ~bits, bits | np.uint64(_SIGN))


def image_value(image: int) -> float:
    """The double of an image; those beyond the infinities are the infinities."""
    bits = image - _SIGN if image >= _SIGN else image ^ (2 ** 64 - 1)
    value = struct.unpack("<d", struct.pack("<Q", bits))[0]
    return value if value == value else math.copysign(math.inf, image - _SIGN)


def _inside(batch: pa.RecordBatch, brackets: list[tuple[int, int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """For every bracket (column, the image's first ``known`` bits, known) the images of its values."""
    images: dict[int, np.ndarray] = {}
    for k, (col, prefix, known) in enumerate(brackets):
        if col not in images:
            x = batch.column(col).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
            images[col] = order_image(x[~np.isnan(x)])
        u = images[col]
        u = u[u >> np.uint64(64 - known) == np.uint64(prefix)] if known else u
        if len(u):
            yield k, u


def _counts(k: int, values: np.ndarray, counts: np.ndarray, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), pa.array(values), pa.array(counts)],
                                      names=["k", name, "c"])


def _histograms(data: DataFrame, brackets: list[tuple[int, int, int]], bits: int) -> DataFrame:
    """``k, bucket, c``: how many values of bracket k have which next ``bits`` bits. Tasks count in
    arrays; equal buckets are added up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(brackets), 1 << bits), np.int64)
        for batch in batches:
            for k, u in _inside(batch, brackets):
                u = (u >> np.uint64(64 - brackets[k][2] - bits)) & np.uint64((1 << bits) - 1)
                counts[k] += np.bincount(u.astype(np.int64), minlength=1 << bits)
        for k in range(len(brackets)):
            at = np.flatnonzero(counts[k])
            if len(at):
                yield _counts(k, at, counts[k][at], "bucket")

    return data.mapInArrow(run, "k int, bucket long, c long").groupBy("k", "bucket").agg(F.sum("c").alias("c"))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], accuracy: int | None = None,
                    max_bracket: int = 50_000) -> dict[str, list[float | None]]:
    """Exact quantiles (linear interpolation between order statistics, as NumPy / pandas) of several
    columns, with bounded memory at any table size. NULL and NaN are left out; a column without
    values has None.

    A radix selection: doubles have 64-bit images in the same order. A pass counts the values by the first bits
    of their image, for all columns at once; the bucket that holds a wanted rank is its bracket, and the next pass
    counts inside the brackets by the next bits (:data:`RADIX_BITS`). No histogram leaves the cluster, only the
    buckets of the ranks. After at most five passes, and as soon as a bracket holds ``max_bracket``
    rows or one value, one grouped count of the values left inside gives the order statistics. (``accuracy``
    is accepted for older callers and changes nothing.)"""
    out: dict[str, list[float | None]] = {}
    for a in range(0, len(cols), COLUMNS_AT_ONCE):
        out.update(_selected(df, cols[a:a + COLUMNS_AT_ONCE], probs, max_bracket))
    return out


class _Rank:
    """One wanted rank of one column and its bracket: the values whose image begins with the ``known``
    bits ``prefix``; ``before`` values are smaller, ``inside`` lie in it."""

    def __init__(self, col: int, rank: int, n: int):
        self.col, self.rank, self.prefix, self.known, self.before, self.inside = col, rank, 0, 0, 0, n

    def narrow(self, bucket: int, bits: int, upto: int, count: int) -> None:
        self.prefix, self.known = self.prefix << bits | bucket, self.known + bits
        self.before, self.inside = self.before + upto - count, count

    @property
    def bracket(self) -> tuple[int, int, int]:
        return self.col, self.prefix, self.known


def _selected(df: DataFrame, cols: list[str], probs: list[float], max_bracket: int) -> dict[str, list[float | None]]:
    spark = df.sparkSession
    x = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in cols]
    data = df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)])
    ranks, n = None, [0] * len(cols)
    for bits in RADIX_BITS:
        open_ = None if ranks is None else [t for t in ranks if t.inside > max_bracket]
        brackets = [(i, 0, 0) for i in range(len(cols))] if ranks is None else sorted({t.bracket for t in open_})
        if not brackets:
            break
        found = _histograms(data, brackets, bits).checkpoint()
        if ranks is None:
            for r in found.groupBy("k").agg(F.sum("c").alias("n")).collect():
                n[r["k"]] = r["n"]
            open_ = ranks = [_Rank(i, r, n[i]) for i in range(len(cols)) if n[i] for r in sorted(
                {r for p in probs for r in (int(p * (n[i] - 1)), min(int(p * (n[i] - 1)) + 1, n[i] - 1))})]
        if not open_:
            break
        number = {b: k for k, b in enumerate(brackets)}
        wanted = spark.createDataFrame([(number[t.bracket], j, t.rank - t.before) for j, t in enumerate(open_)],
                                       "k int, j int, place long")  # two rows a column and probability
        upto = F.sum("c").over(Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        at = found.withColumn("upto", upto).join(F.broadcast(wanted), "k").where(
            (F.col("upto") > F.col("place")) & (F.col("upto") - F.col("c") <= F.col("place")))
        for r in at.collect():
            open_[r["j"]].narrow(r["bucket"], bits, r["upto"], r["c"])
    values = _values_at(data, ranks)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        out[c] = [None] * len(probs)
        for j, p in enumerate(probs if n[i] else ()):
            pos = p * (n[i] - 1)
            v0, v1 = values[i, int(pos)], values[i, min(int(pos) + 1, n[i] - 1)]
            out[c][j] = v0 + (v1 - v0) * (pos - int(pos)) if v1 != v0 else v0
    return out


def _values_at(data: DataFrame, ranks: list[_Rank]) -> dict[tuple[int, int], float]:
    """The value at every rank, from counts of the values inside its bracket (few, or one value)."""
    out = {(t.col, t.rank): image_value(t.prefix) for t in ranks if t.known == 64}
    brackets = sorted({t.bracket for t in ranks if t.known < 64})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in brackets]
        for batch in batches:
            for k, u in _inside(batch, brackets):
                parts[k].append(u)
        for k, part in enumerate(parts):
            if part:
                values, counts = np.unique(np.concatenate(part), return_counts=True)
                yield _counts(k, (values ^ np.uint64(_SIGN)).view(np.int64), counts, "v")

    if brackets:
        counted = data.mapInArrow(run, "k int, v long, c long").groupBy("k", "v").agg(F.sum("c").alias("c")).orderBy("k", "v")
        waiting = [[t for t in ranks if t.bracket == b] for b in brackets]
        seen = [ts[0].before for ts in waiting]
        for r in counted.collect():
            seen[r["k"]] += r["c"]
            for t in waiting[r["k"]]:
                if seen[r["k"]] > t.rank:
                    out.setdefault((t.col, t.rank), image_value(r["v"] + _SIGN))
    return out


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float], accuracy="auto") -> dict[str, list[float | None]]:
    """Whole-table quantiles per column, exact (:func:`exact_quantiles`); an int ``accuracy`` gives the
    sketch's values instead."""
    if not cols:
        return {}
    if isinstance(accuracy, int) and not isinstance(accuracy, bool):
        row = df.agg(*[F.percentile_approx(F.col(f"`{c}`").cast("double"), list(probs), accuracy).alias(f"q{i}")
                       for i, c in enumerate(cols)]).first()
        return {c: list(row[f"q{i}"] or [None] * len(probs)) for i, c in enumerate(cols)}
    return exact_quantiles(df, cols, list(probs))


#: Tables of up to so many groups are sent to the rows; with more, rows are dealt by their group.
MAX_BROADCAST_GROUPS = 10_000
#: Value ranges that a group's bracket is counted in before single values are.
_STEPS = 256


def grouped_quantiles(df: DataFrame, keys: list[str], col: str, probs: list[float], accuracy="auto",
                      sketch_accuracy: int = 10_000, extra: tuple = ()) -> DataFrame:
    """Exact per-group quantiles (linear interpolation) as a DataFrame ``keys + [q0, q1, ...]``.

    Everything stays distributed: a per-group sketch proposes a bracket around each wanted rank, the
    brackets are joined back on the keys (broadcast up to :data:`MAX_BROADCAST_GROUPS`, else AQE splits a hot
    group's partition), and rows below and inside are counted. Inside, rows are counted by steps of the bracket first, then by value in the
    step that holds the rank, so a hot group's values do not meet in one task. Groups of which a
    bracket misses its rank are done again with brackets ten times as wide, in the end their whole
    range. An int ``accuracy`` gives the sketch instead. ``extra`` are more aggregates over ``_v`` (the
    non-missing values), computed in the same grouped pass."""
    v = F.nanvl(F.col(f"`{col}`").cast("double"), F.lit(None))
    data = df.select(*[F.col(f"`{k}`") for k in keys], v.alias("_v")).where(F.col("_v").isNotNull())
    names = [f"q{j}" for j in range(len(probs))]
    if isinstance(accuracy, int) and not isinstance(accuracy, bool):
        g = data.groupBy(*keys).agg(F.percentile_approx("_v", list(probs), accuracy).alias("_q"), *extra)
        return g.select(*[c for c in g.columns if c != "_q"], *[F.col("_q")[j].alias(n) for j, n in enumerate(names)])
    return _bracketed(data, keys, list(probs), 2.0 / sketch_accuracy, sketch_accuracy, tuple(extra))


def _bracketed(data: DataFrame, keys: list[str], probs: list[float], d: float, accuracy: int, extra: tuple) -> DataFrame:
    m = len(probs)
    ends = [min(1.0, max(0.0, p + s * d)) for p in probs for s in (-1, 1)]
    # at the ends of the range the bracket takes the smallest and largest value themselves
    sketch = F.percentile_approx("_v", ends, accuracy)
    info = data.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                   sketch.alias("_s"), *extra)
    more = [c for c in info.columns if c not in {*keys, "_n", "_min", "_max", "_s"}]
    cols = [*keys, *more, "_n"]
    for j, p in enumerate(probs):
        at = F.floor(F.lit(p) * (F.col("_n") - 1)).cast("long")
        low = F.col("_min") if ends[2 * j] <= 0 else F.col("_s")[2 * j]
        high = F.col("_max") if ends[2 * j + 1] >= 1 else F.col("_s")[2 * j + 1]
        cols += [low.alias(f"_lo{j}"), high.alias(f"_hi{j}"), at.alias(f"_r{j}"),
                 (F.lit(p) * (F.col("_n") - 1) - at).alias(f"_f{j}")]
    info = info.select(*cols).checkpoint()
    # few groups hold many rows each: dealt by group, all of a group's rows would be sorted in one task
    few = info.count() <= MAX_BROADCAST_GROUPS
    brackets = info.drop(*more)
    joined = data.join(F.broadcast(brackets) if few else brackets, keys)
    # one pass: of every row, for each bracket, that it lies below (step -1) or its step and value
    below_or_inside = []
    for j in range(m):
        lo, hi, x = F.col(f"_lo{j}"), F.col(f"_hi{j}"), F.col("_v")
        step = F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * _STEPS), F.lit(_STEPS - 1))).otherwise(F.lit(0))
        below_or_inside.append(
            F.when(x < lo, F.struct(F.lit(j).alias("j"), F.lit(-1).alias("step"), F.lit(None).cast("double").alias("v")))
            .when(x <= hi, F.struct(F.lit(j).alias("j"), step.cast("int").alias("step"), x.alias("v"))))
    hist = (joined.select(*keys, F.explode(F.filter(F.array(*below_or_inside), lambda e: e.isNotNull())).alias("e"))
            .select(*keys, "e.*").groupBy(*keys, "j", "step", "v").agg(F.count("*").alias("c")).checkpoint())
    below = hist.groupBy(*keys).agg(
        *[F.sum(F.when((F.col("j") == j) & (F.col("step") < 0), F.col("c")).otherwise(0)).alias(f"_b{j}") for j in range(m)],
        *[F.sum(F.when((F.col("j") == j) & (F.col("step") >= 0), F.col("c")).otherwise(0)).alias(f"_w{j}") for j in range(m)])
    hist = hist.where("step >= 0")
    info = info.join(below, keys).checkpoint()
    missed = F.lit(False)
    for j in range(m):
        missed = missed | (F.col(f"_b{j}") > F.col(f"_r{j}")) | (
            F.col(f"_b{j}") + F.col(f"_w{j}") <= F.least(F.col(f"_r{j}") + 1, F.col("_n") - 1))
    again = info.where(missed).select(*keys)
    wanted = info.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(j).alias("j"), F.col(f"_b{j}").alias("below"), F.col(f"_r{j}").alias("r0"),
                 F.least(F.col(f"_r{j}") + 1, F.col("_n") - 1).alias("r1")) for j in range(m)])).alias("t")).select(*keys, "t.*")
    before = Window.partitionBy(*keys, "j").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = (hist.groupBy(*keys, "j", "step").agg(F.sum("c").alias("sc")).join(wanted, [*keys, "j"])
             .withColumn("from", F.col("below") + F.coalesce(F.sum("sc").over(before), F.lit(0))))
    held = F.lit(False)
    for r in ("r0", "r1"):
        held = held | ((F.col("from") <= F.col(r)) & (F.col(r) < F.col("from") + F.col("sc")))
    run = Window.partitionBy(*keys, "j", "step").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = (hist.join(steps.where(held).drop("sc", "below"), [*keys, "j", "step"])
            .withColumn("end", F.col("from") + F.sum("c").over(run)))
    at = [F.min(F.when((F.col("j") == j) & (F.col("end") > F.col(r)), F.col("v"))).alias(f"_{r}{j}")
          for j in range(m) for r in ("r0", "r1")]
    found = upto.groupBy(*keys).agg(*[a.alias(f"_v{k}") for k, a in enumerate(at)])
    out = info.where(~missed).join(found, keys).select(*keys, *more, *[
        (F.col(f"_v{2 * j}") + (F.col(f"_v{2 * j + 1}") - F.col(f"_v{2 * j}")) * F.col(f"_f{j}")).alias(f"q{j}")
        for j in range(m)])
    if d < 1 and not again.isEmpty():
        out = out.unionByName(_bracketed(data.join(F.broadcast(again) if few else again, keys, "left_semi"), keys, probs, d * 10, accuracy, extra))
    return out
