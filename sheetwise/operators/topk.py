"""Exact-size random samples of rows, independent of the rows' values.

Every row draws a number from Spark's seeded generator, which depends on the row's partition and
its place in it, never on its content: equal rows are drawn independently. The ``k`` smallest draws
are the sample. Only rows under a threshold that about ``4 k`` of the ``n`` rows pass are sorted, so
no task forwards ``k`` rows for the sake of a few; if fewer than ``k`` pass (a chance of practically
nil) the threshold is raised. The sample is checkpointed: it is the same for every later reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERSAMPLE = 4


def random_rows(df: DataFrame, k: int, n: int, seed: int, name: str = "_u") -> DataFrame:
    """``k`` of the ``n`` rows of ``df``, every set of ``k`` rows equally likely, with column ``name``
    holding the draws. Repeatable for the same input files and the same plan."""
    share = OVERSAMPLE * (k + 16) / max(n, 1)
    drawn = df.withColumn(name, F.rand(seed))
    while True:
        few = drawn if share >= 1 else drawn.where(F.col(name) < share)
        top = few.orderBy(name).limit(k).checkpoint()
        if share >= 1 or top.count() >= k:
            return top
        share *= OVERSAMPLE


def hashable_columns(df: DataFrame) -> list[Column]:
    """Every column as something ``xxhash64`` accepts: a map takes part as its entries sorted by
    key (Spark does not hash maps), so equal rows hash equally."""
    from pyspark.sql import types as T
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        out.append(F.array_sort(F.map_entries(c)) if isinstance(f.dataType, T.MapType) else c)
    return out


def row_hash(df: DataFrame, seed: int) -> Column:
    """A seeded 64-bit hash of the whole row."""
    return F.xxhash64(*hashable_columns(df), F.lit(seed))
