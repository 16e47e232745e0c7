"""Profiling and column roles: P1 statistics, P2 correlations, P3 category breakdown,
P4 histogram, P5 box summary, P6 question profile, P7 sample values, P8/P9/P11 column roles,
P13 quality scores, P14 recommendations, P16 readable labels.

Discipline: all columns in one aggregate per pass; results in long form (one row per column or
per pair) so they stay DataFrames; only per-column scalars reach the driver where a *decision*
(a column choice) has to be made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import naming as N
from sheetwise.functions.missing import nan_to_null
from sheetwise.functions.quantiles import column_quantiles, grouped_quantiles

STAT_COLUMNS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def _long_form(one_row: DataFrame, per_col: dict[str, list[str]], names: list[str]) -> DataFrame:
    """Turn a one-row wide aggregate into one row per column with ``names`` fields, using
    ``stack`` (a generator, no shuffle)."""
    args = []
    for col, fields in per_col.items():
        args.append(F.lit(col))
        args += [F.col(f) for f in fields]
    return one_row.select(F.stack(F.lit(len(per_col)), *args).alias("column", *names))


def compute_stats(df: DataFrame, accuracy="auto", digits: int = 3) -> DataFrame | None:
    """Per numeric column ``count, mean, std (sample), min, p25, p50, p75, max`` rounded to
    ``digits``; ``_anomaly_score`` is left out. ``None`` when there is no numeric column.

    One aggregate for the moments, quartiles by :func:`column_quantiles` (exact at any size);
    the result has one row per column, built from those bounded figures."""
    cols = [c for c in N.numeric_columns(df, include_internal=True) if c != "_anomaly_score"]
    if not cols:
        return None
    df = nan_to_null(df.select(*[F.col(f"`{c}`") for c in cols]))
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    base = df.agg(*aggs).first()
    qs = column_quantiles(df, cols, [0.25, 0.5, 0.75], accuracy)

    def r(v):
        return None if v is None else _round_half_even(float(v), digits)
    rows = [(c, r(base[f"n{i}"]), r(base[f"m{i}"]), r(base[f"s{i}"]), r(base[f"lo{i}"]),
             r(qs[c][0]), r(qs[c][1]), r(qs[c][2]), r(base[f"hi{i}"])) for i, c in enumerate(cols)]
    schema = "column string, " + ", ".join(f"{k} double" for k in STAT_COLUMNS)
    return df.sparkSession.createDataFrame(rows, schema)


def _round_half_even(v: float, digits: int) -> float:
    """Half-to-even rounding on the decimal form of ``v`` (as Spark's ``bround``)."""
    from decimal import ROUND_HALF_EVEN, Decimal
    if v != v or v in (float("inf"), float("-inf")):
        return v
    return float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_EVEN))


#: Columns of a block of the matrices that `correlations` sums: a block row of 64 by p columns.
GRAM_BLOCK = 64


def correlations(df: DataFrame, cols: list[str] | None = None, digits: int | None = 2) -> DataFrame:
    """Pearson correlation ``[x, y, r]`` for every ordered pair of the numeric columns (or of
    ``cols``), pairwise-complete (a row counts for a pair when both values are present; NaN is
    missing). A pair with a constant column, or with fewer than one common row, has NULL.

    Two scans for any number of columns. The first gets each column's count, mean, variance and whether it
    is constant. In the second, tasks multiply Arrow batches of values centred on those means (well
    conditioned) into Gram matrices: X'X and, where columns have missing values, their products with the
    masks and the squares (at most six p by p matrices a task: 12 MB for 500 columns). They are cut
    into rows of blocks and added up in two rounds, first within groups of tasks; coefficients are
    computed from the summed blocks in tasks as well."""
    cols = cols or N.numeric_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "x string, y string, r double")
    p = len(cols)
    data = nan_to_null(df.select(*[F.col(f"`{c}`") for c in cols])).select(
        *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    first = data.agg(F.count("*").alias("n"), *[a for i in range(p) for a in (
        F.count(f"x{i}").alias(f"k{i}"), F.avg(f"x{i}").alias(f"m{i}"), F.var_pop(f"x{i}").alias(f"s{i}"),
        (F.min(f"x{i}") < F.max(f"x{i}")).alias(f"v{i}"))]).first()
    n = first["n"]
    means = np.array([first[f"m{i}"] or 0.0 for i in range(p)])
    varies = np.array([bool(first[f"v{i}"]) for i in range(p)])
    spread = np.array([first[f"s{i}"] or 0.0 for i in range(p)])
    full = all(first[f"k{i}"] == n for i in range(p))
    kinds = ("sp",) if full else ("n", "sa", "sb", "sp", "saa", "sbb")
    starts = range(0, p, GRAM_BLOCK)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(kinds), p, p))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in batch.columns]) - means
            if full:
                total[0] += x.T @ x
                continue
            m = (~np.isnan(x)).astype(np.float64)
            x = np.where(m == 1, x, 0.0)
            here, sums, squares = m.T @ m, x.T @ m, (x * x).T @ m
            total += np.stack([here, sums, sums.T, x.T @ x, squares, squares.T])
        for a in starts:
            yield pa.RecordBatch.from_arrays(
                [pa.array([a], pa.int32()), pa.array([total[:, a:a + GRAM_BLOCK].tobytes()], pa.binary())], names=["block", "sums"])

    def added(table: pa.Table) -> pa.Table:
        parts = iter(table["sums"])
        total = np.frombuffer(next(parts).as_py()).copy()
        for part in parts:
            total += np.frombuffer(part.as_buffer())
        return pa.table({"block": table["block"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    def coefficients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(cols, object)
        for batch in batches:
            for a, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = dict(zip(kinds, np.frombuffer(sums.as_buffer()).reshape(len(kinds), -1, p), strict=True))
                rows = np.arange(a, a + len(s["sp"]))
                with np.errstate(all="ignore"):
                    if full:
                        cov, va, vb = s["sp"] / n, spread[rows][:, None], spread[None, :]
                    else:
                        ma, mb = s["sa"] / s["n"], s["sb"] / s["n"]
                        cov, va, vb = s["sp"] / s["n"] - ma * mb, s["saa"] / s["n"] - ma * ma, s["sbb"] / s["n"] - mb * mb
                    den = np.sqrt(np.maximum(va, 0) * np.maximum(vb, 0))
                    r = np.where(rows[:, None] == np.arange(p)[None, :], 1.0, cov / den)
                known = (den > 0) & varies[rows][:, None] & varies[None, :] & np.isfinite(r)
                for i, row in enumerate(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([cols[row]] * p, pa.string()), pa.array(names, pa.string()),
                         pa.array(r[i], pa.float64(), mask=~known[i])], names=["x", "y", "r"])

    schema = "block int, sums binary"
    parts = data.mapInArrow(grams, schema).withColumn("part", F.spark_partition_id() % 32)
    merged = parts.groupBy("block", "part").applyInArrow(added, schema).groupBy("block").applyInArrow(added, schema)
    out = merged.mapInArrow(coefficients, "x string, y string, r double")
    # no -0.0
    return out.withColumn("r", F.bround("r", digits) + F.lit(0.0)) if digits is not None else out


def category_breakdown(df: DataFrame, column: str, top_n: int = 15) -> DataFrame:
    """``[column, count]`` for the ``top_n`` most frequent non-NULL values (ties by value)."""
    N.require_columns(df, column)
    return (df.select(column).where(F.col(column).isNotNull())
              .groupBy(column).agg(F.count("*").alias("count"))
              .orderBy(F.col("count").desc(), F.col(column).asc())
              .limit(top_n))


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """``[bin, lo, hi, count]`` over ``bins`` equal-width bins spanning [min, max] of all
    non-NULL values (the maximum falls in the last bin); empty bins are listed with 0."""
    N.require_columns(df, column)
    x = F.col(column).cast("double")
    data = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    bounds = data.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, hi = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    width = F.when(hi > lo, (hi - lo) / bins).otherwise(F.lit(1.0))
    b = F.least(F.floor((F.col("x") - lo) / width).cast("int"), F.lit(bins - 1))
    counts = data.select(b.alias("bin")).groupBy("bin").agg(F.count("*").alias("count"))
    all_bins = bounds.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
                             F.col("lo"), F.col("hi"))
    w = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(F.lit(1.0))
    return (all_bins.join(counts, "bin", "left")
                    .select("bin", (F.col("lo") + F.col("bin") * w).alias("lo"),
                            (F.col("lo") + (F.col("bin") + 1) * w).alias("hi"),
                            F.coalesce(F.col("count"), F.lit(0)).alias("count"))
                    .where(F.col("lo").isNotNull())
                    .orderBy("bin"))


def box_summary(df: DataFrame, column: str, by: str | None = None, accuracy="auto") -> DataFrame:
    """P5: five-number summary per group (or overall): ``[by], n, min, q1, median, q3, max,
    lower_fence, upper_fence, whisker_low, whisker_high, outliers`` with 1.5 IQR fences; whiskers
    are the most extreme values inside the fences. Overall: exact quartiles at any size, then one
    whisker aggregate. Per group: quartiles per group, then fences joined back on the group key
    for the whisker/outlier pass."""
    N.require_columns(df, column, by)
    keys = [by] if by else []
    x = F.nanvl(F.col(column).cast("double"), F.lit(None))
    data = df.select(*keys, x.alias("v")).where(F.col("v").isNotNull())
    if by:
        data = data.where(F.col(by).isNotNull())
    if not by:
        # whole-table quartiles: exact at any size (see column_quantiles)
        base = data.agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max")).first()
        q1, med, q3 = column_quantiles(data, ["v"], [0.25, 0.5, 0.75], accuracy)["v"]
        iqr = (q3 - q1) if q1 is not None else None
        lf = q1 - 1.5 * iqr if iqr is not None else None
        uf = q3 + 1.5 * iqr if iqr is not None else None
        inside = (F.col("v") >= F.lit(lf)) & (F.col("v") <= F.lit(uf))
        return (data.agg(F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
                         F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
                         F.count_if(~inside).alias("outliers"))
                    .select(F.lit(base["n"]).cast("long").alias("n"), F.lit(base["min"]).cast("double").alias("min"),
                            F.lit(q1).cast("double").alias("q1"), F.lit(med).cast("double").alias("median"),
                            F.lit(q3).cast("double").alias("q3"), F.lit(base["max"]).cast("double").alias("max"),
                            F.lit(lf).cast("double").alias("lower_fence"), F.lit(uf).cast("double").alias("upper_fence"),
                            "whisker_low", "whisker_high", "outliers"))
    # per group: exact quartiles at any size (see grouped_quantiles), counts in the same pass
    qs = (grouped_quantiles(data, keys, "v", [0.25, 0.5, 0.75], accuracy,
                            extra=(F.count("*").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max")))
              .select(*keys, "n", "min", F.col("q0").alias("q1"), F.col("q1").alias("median"),
                      F.col("q2").alias("q3"), "max")
              .withColumn("lower_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")))
              .withColumn("upper_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
              .checkpoint())  # one row per group, joined twice below
    inside = (F.col("v") >= F.col("lower_fence")) & (F.col("v") <= F.col("upper_fence"))
    whisker_aggs = [F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
                    F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
                    F.count_if(~inside).alias("outliers")]
    # One row per group on the right; AQE broadcasts it when its measured size is small and
    # splits a hot group's partition when it is not.
    joined = data.join(qs.select(by, "lower_fence", "upper_fence"), by)
    return qs.join(joined.groupBy(by).agg(*whisker_aggs), by)


def numeric_profile(df: DataFrame, cols: list[str] | None = None, digits: int = 2) -> DataFrame:
    """P6 (numbers): for the numeric columns (or ``cols``) ``column, mean, min, max, std, sum, count``
    rounded to ``digits``, NULLs and NaN ignored."""
    cols = cols or N.numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column string, mean double, min double, max double, std double, sum double, count long")
    aggs, per_col = [], {}
    for i, c in enumerate(cols):
        x = F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None))
        aggs += [F.bround(F.avg(x), digits).alias(f"a{i}"), F.bround(F.min(x), digits).alias(f"b{i}"),
                 F.bround(F.max(x), digits).alias(f"c{i}"), F.bround(F.stddev_samp(x), digits).alias(f"d{i}"),
                 F.bround(F.sum(x), digits).alias(f"e{i}"), F.count(x).alias(f"f{i}")]
        per_col[c] = [f"{k}{i}" for k in "abcdef"]
    return _long_form(df.agg(*aggs), per_col, ["mean", "min", "max", "std", "sum", "count"])


def category_profile(df: DataFrame, cols: list[str] | None = None, top_n: int = 5) -> DataFrame:
    """P6 (categories): ``column, value, count, rank`` of the ``top_n`` most frequent values of
    the text/boolean columns (or ``cols``). One unpivot, one grouped count, then a
    per-column ``row_number`` limit (Spark prunes it per partition before the shuffle)."""
    from pyspark.sql import Window
    cols = cols or N.category_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, value string, count long, rank int")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value").where(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count("*").alias("count"))
    w = Window.partitionBy("column").orderBy(F.col("count").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def sample_values(df: DataFrame, k: int = 3, cols: list[str] | None = None) -> DataFrame:
    """``column, rank, value`` - the ``k`` smallest distinct non-NULL values of each column, as
    text. One pass over the table: each task keeps ``k`` values a column (Arrow batches, sorted as the
    column's type), and only those are shuffled and ranked."""
    from pyspark.sql import Window
    from pyspark.sql import types as T
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    cols = cols or [f.name for f in df.schema.fields
                    if not N.is_internal(f.name) and not isinstance(f.dataType, nested)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string")
    data = nan_to_null(df.select(*[F.col(f"`{c}`") for c in cols])).select(*[
        (F.col(f"`{c}`").cast("string") if isinstance(df.schema[c].dataType, T.BooleanType) else F.col(f"`{c}`")).alias(f"c{i}")
        for i, c in enumerate(cols)])

    def smallest(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        kept: list = [None] * len(cols)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                values = pc.unique(column.drop_null())
                if kept[i] is not None:
                    values = pc.unique(pa.concat_arrays([kept[i], values]))
                kept[i] = values.take(pc.sort_indices(values)[:k])
        kinds = [None if v is None else v.type for v in kept]
        for i, v in enumerate(kept):
            if v is not None and len(v):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(v), pa.int32()),
                     *[v if j == i else pa.nulls(len(v), kind) for j, kind in enumerate(kinds)]],
                    names=["i", *[f"c{j}" for j in range(len(cols))]])

    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(data.schema.fields))
    few = data.mapInArrow(smallest, f"i int, {fields}").distinct()
    order = Window.partitionBy("i").orderBy(*[f"c{i}" for i in range(len(cols))])
    names = F.array(*[F.lit(c) for c in cols])
    return (few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(names[F.col("i")].alias("column"), "rank",
                    F.coalesce(*[F.col(f"c{i}").cast("string") for i in range(len(cols))]).alias("value")))


def column_cardinality(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """P8/P9/P11 input: ``column, n_distinct, n_nonnull`` per column, exact at any size: (column,
    value) pairs are grouped once, as text, with map-side combining, then counted per column."""
    cols = cols or list(df.columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_distinct long, n_nonnull long")
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
                               for c in cols]))
    counted = (df.select(pair.alias("p")).select("p.*").groupBy("column", "value").agg(F.count("*").alias("n"))
               .groupBy("column").agg(F.count("value").alias("n_distinct"),
                                      F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("n_nonnull")))
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return every.join(counted, "column", "left").na.fill(0, ["n_distinct", "n_nonnull"])


#: A column whose values are distinct on more than this share of its non-NULL rows identifies rows.
IDENTIFIER_SHARE = 0.95
#: Distinct values of a column that rows can usefully be grouped by.
CATEGORY_SIZES = range(2, 51)


def looks_like_identifier(name: str, n_distinct: int, n_nonnull: int) -> bool:
    """Identifier by name, or nearly all values distinct (> 95 % of the non-NULL ones)."""
    return N.has_identifier_name(name) or n_distinct > IDENTIFIER_SHARE * n_nonnull


def suggest_roles(df: DataFrame) -> dict:
    """Default ``category`` and ``metric`` with ``binary`` (P11: category columns with exactly two
    values) and the cardinality table they were decided on.

    The category is the groupable column with the most distinct values (2 to 50), or else the first
    category column. Metrics are ranked: measures named like money or volume totals first, then like
    quantities or prices, then other columns that do not identify rows, then the rest; of equals the
    first column."""
    cats, nums = N.category_columns(df), N.numeric_columns(df)
    card = column_cardinality(df, cats + nums).checkpoint()
    size = {r["column"]: (r["n_distinct"], r["n_nonnull"]) for r in card.collect()}

    def category_rank(c):
        return size[c][0] if size[c][0] in CATEGORY_SIZES else 0

    def metric_rank(c):
        if looks_like_identifier(c, *size[c]):
            return 3
        words = set(N.name_tokens(c))
        tiers = [words & N.METRIC_NAME_HINTS_TIER1, words & N.METRIC_NAME_HINTS_TIER2, True]
        return next(i for i, hit in enumerate(tiers) if hit)

    return {"category": max(cats, key=category_rank, default=None), "metric": min(nums, key=metric_rank, default=None),
            "binary": [c for c in cats if size[c][0] == 2], "cardinality": card}


def quality_scores(report: DataFrame, anomaly: DataFrame | None = None) -> DataFrame:
    """One row ``completeness, duplicate_rate, anomaly_rate`` (each rounded to 1) from the
    one-row clean report (``original_rows, original_cols, total_missing,
    duplicates_removed``) and optional anomaly summary (``anomaly_pct``)."""
    cells = F.col("original_rows") * F.col("original_cols")
    completeness = F.when(cells > 0, F.bround(100 - F.col("total_missing") / cells * 100, 1)).otherwise(100.0)
    dup = F.when(F.col("original_rows") > 0,
                 F.bround(F.col("duplicates_removed") / F.col("original_rows") * 100, 1)).otherwise(0.0)
    out = report.select(completeness.cast("double").alias("completeness"),
                        dup.cast("double").alias("duplicate_rate"), "total_missing", "duplicates_removed")
    if anomaly is not None:
        rate = anomaly.select(F.col("anomaly_pct").cast("double")).scalar()
        out = out.withColumn("anomaly_rate", F.coalesce(rate, F.lit(0.0)))
    else:
        out = out.withColumn("anomaly_rate", F.lit(0.0))
    return out


def recommendations(scores: DataFrame) -> DataFrame:
    """``title, severity, category, recommendation`` rows from the quality scores (rules:
    completeness < 95 Medium, < 80 High; duplicates > 0 Medium, > 10 High; anomalies > 0
    Medium; none of these gives one Low 'healthy' row). Own wording."""
    c, d, a = F.col("completeness"), F.col("duplicate_rate"), F.col("anomaly_rate")

    def rec(cond, title, sev, cat, text):
        return F.when(cond, F.struct(F.lit(title).alias("title"), sev.alias("severity"),
                                     F.lit(cat).alias("category"), text.alias("recommendation")))

    rules = F.array(
        rec(c < 95, "Missing data detected", F.when(c < 80, "High").otherwise("Medium"), "Data Quality",
            F.format_string("%d missing values were filled in; look at how the data is collected.",
                            F.col("total_missing"))),
        rec(d > 0, "Duplicate rows found", F.when(d > 10, "High").otherwise("Medium"), "Data Quality",
            F.format_string("%d repeated rows were removed (%s%% of the rows).",
                            F.col("duplicates_removed"), d.cast("string"))),
        rec(a > 0, "Unusual rows flagged", F.lit("Medium"), "Anomaly",
            F.format_string("%s%% of rows were flagged as outliers; review them.", a.cast("string"))),
    )
    healthy = F.array(F.struct(F.lit("Data looks healthy").alias("title"), F.lit("Low").alias("severity"),
                               F.lit("Data Quality").alias("category"),
                               F.lit("No major data quality issue was found.").alias("recommendation")))
    kept = F.filter(rules, lambda r: r.isNotNull())
    return (scores.select(F.explode(F.when(F.size(kept) > 0, kept).otherwise(healthy)).alias("r"))
                  .select("r.title", "r.severity", "r.category", "r.recommendation"))


def relabel(df: DataFrame, overrides: dict | None = None, drop_internal: bool = True) -> DataFrame:
    """One ``select`` renaming every column to its readable label (user overrides win)."""
    overrides = overrides or {}
    cols = [c for c in df.columns if not (drop_internal and N.is_internal(c))]
    return df.select(*[F.col(f"`{c}`").alias(overrides.get(c, N.humanize(c))) for c in cols])


def column_labels(df: DataFrame, overrides: dict | None = None) -> dict[str, str]:
    overrides = overrides or {}
    return {c: overrides.get(c, N.humanize(c)) for c in df.columns if not N.is_internal(c)}
