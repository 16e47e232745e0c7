"""Group rankings and shares: G1 top performers, G2 concentration (HHI), G3 KPI summary,
G4 chart aggregate with top-N x values, G5 automatic sum/mean choice.

Shape of every plan: one partial + final hash aggregate on the category (map-side combine, a
single shuffle of at most one row per category per task), then work over the grouped table only.
Grand totals are scalar subqueries (one value, inlined), never a join. Null category keys are
dropped before grouping, as a pandas ``groupby`` does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.missing import nan_to_null
from sheetwise.functions.naming import is_rate_like, require_columns
from sheetwise.functions.quantiles import grouped_quantiles

AGGREGATES = ("sum", "mean", "count", "min", "max", "median")


def auto_agg(metric: str) -> str:
    """Mean for rate-like metric names, otherwise sum."""
    return "mean" if is_rate_like(metric) else "sum"


def metric_agg(metric: str, how: str, accuracy: int | None = None) -> Column:
    """The aggregate of one metric column as pandas computes it: sum of nothing is 0, the
    others ignore NULLs and give NULL when nothing is left."""
    c = F.col(metric)
    if how == "sum":
        return F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
    if how == "mean":
        return F.avg(c).cast("double")
    if how == "count":
        return F.count(c)
    if how == "min":
        return F.min(c)
    if how == "max":
        return F.max(c)
    if how == "median":
        if accuracy:
            return F.percentile_approx(c, 0.5, accuracy).cast("double")
        return F.percentile(c, F.lit(0.5)).cast("double")
    raise ValueError(f"unknown aggregate {how!r}; expected one of {AGGREGATES}")


def _grouped(df: DataFrame, category: str, metric: str, how: str) -> DataFrame:
    return (nan_to_null(df.select(category, metric), metric)
              .where(F.col(category).isNotNull())
              .groupBy(category)
              .agg(metric_agg(metric, how).alias("total")))


def _share(total: Column, grand: Column, scale: float) -> Column:
    return F.when(grand != 0, F.try_divide(total, grand) * scale).otherwise(F.lit(0.0))


def top_performers(df: DataFrame, category: str, metric: str, top_n: int = 10) -> DataFrame:
    """G1: ``[category, total, share_pct]`` for the ``top_n`` categories by total, descending.

    ``total`` is the sum of the metric per category, or its mean for rate-like metric names;
    ``share_pct`` is the category's share of the summed totals of *all* categories, rounded to
    one decimal (half to even), 0 when those totals sum to 0. Ties at the border are broken by
    the category ascending."""
    require_columns(df, category, metric)
    grouped = _grouped(df, category, metric, auto_agg(metric))
    grand = grouped.select(F.sum("total")).scalar()
    return (grouped
            .withColumn("share_pct", F.bround(_share(F.col("total"), grand, 100.0), 1))
            .orderBy(F.col("total").desc_nulls_last(), F.col(category).asc())
            .limit(top_n))


def concentration_risk(df: DataFrame, category: str, amount: str) -> dict[str, DataFrame]:
    """Herfindahl-Hirschman index of ``amount`` over ``category``.

    Returns ``summary`` (one row: hhi rounded to 4, risk_level Low < 0.15 <= Moderate < 0.25 <=
    High on the unrounded index, top_category, top_category_share_pct rounded to 1) and
    ``breakdown`` (category, total, share) ordered by total descending."""
    require_columns(df, category, amount)
    grouped = _grouped(df, category, amount, "sum")
    grand = grouped.select(F.sum("total")).scalar()
    share = _share(F.col("total"), grand, 1.0)
    breakdown = grouped.withColumn("share", share)
    top = F.min(F.struct((-F.col("total")).alias("k"), F.col(category).alias("c")))
    summary = (breakdown
               .agg(F.sum(F.col("share") * F.col("share")).alias("hhi_raw"),
                    top.alias("_top"), F.count("*").alias("_n"))
               .select(F.bround(F.coalesce("hhi_raw", F.lit(0.0)), 4).alias("hhi"),
                       F.when(F.coalesce("hhi_raw", F.lit(0.0)) < 0.15, "Low")
                        .when(F.col("hhi_raw") < 0.25, "Moderate").otherwise("High")
                        .alias("risk_level"),
                       F.col("_top.c").alias("top_category"),
                       F.coalesce(F.bround(_share(-F.col("_top.k"), grand, 100.0), 1), F.lit(0.0))
                        .alias("top_category_share_pct")))
    return {"summary": summary,
            "breakdown": breakdown.orderBy(F.col("total").desc(), F.col(category).asc())}


def kpi_summary(df: DataFrame, category: str, metric: str) -> DataFrame:
    """One row ``total, category_count, top_category, top_category_share_pct,
    avg_per_category, agg``.

    For rate-like metrics the headline ``total`` is the mean over *all* rows (NULL categories
    included); otherwise it is the sum of the per-category totals. One pass over the data:
    per-category partial sums and counts (NULL category kept as its own group), then one small
    aggregate over those groups."""
    require_columns(df, category, metric)
    how = auto_agg(metric)
    m = F.col(metric)
    per_cat = (nan_to_null(df.select(category, metric), metric)
                 .groupBy(category)
                 .agg(F.sum(m).cast("double").alias("s"), F.count(m).alias("n")))
    keyed = F.col(category).isNotNull()
    cat_total = (F.coalesce(F.col("s"), F.lit(0.0)) if how == "sum"
                 else F.try_divide(F.col("s"), F.col("n")))
    per_cat = per_cat.withColumn("total", F.when(keyed, cat_total))
    summary = per_cat.agg(
        F.sum(F.when(keyed, F.col("total"))).alias("grouped_sum"),
        F.count_if(keyed).alias("category_count"),
        F.try_divide(F.sum("s"), F.sum("n")).alias("row_mean"),
        F.min(F.when(keyed & F.col("total").isNotNull(),
                     F.struct((-F.col("total")).alias("k"), F.col(category).alias("c")))).alias("_top"),
        F.min(F.when(keyed, F.col(category))).alias("_first_cat"))
    gsum = F.coalesce(F.col("grouped_sum"), F.lit(0.0))
    headline = F.coalesce(F.col("row_mean"), F.lit(0.0)) if how == "mean" else gsum
    top_total = -F.col("_top.k")
    return summary.select(
        F.bround(headline, 2).alias("total"),
        F.col("category_count"),
        F.coalesce(F.col("_top.c"), F.col("_first_cat")).alias("top_category"),
        F.coalesce(F.bround(_share(top_total, gsum, 100.0), 1), F.lit(0.0)).alias("top_category_share_pct"),
        F.when(F.col("category_count") > 0,
               F.bround(F.try_divide(gsum, F.col("category_count")), 2)).otherwise(F.lit(0.0))
         .alias("avg_per_category"),
        F.lit(how).alias("agg"))


def chart_aggregate(df: DataFrame, x: str, y: str, color: str | None = None, agg: str = "auto",
                    top_n: int | None = None, accuracy: int | None = None) -> DataFrame:
    """``y`` aggregated per ``x`` (and per ``color``), keeping only the ``top_n`` x values
    ranked by the sum of the aggregate over colours.

    The top-x list has at most ``top_n`` rows (the builder caps it at 100), so it is broadcast
    for a left-semi join; it never grows with the data."""
    require_columns(df, x, y, color)
    if x == y:
        raise ValueError("x and y are the same column; pick two different columns")
    how = auto_agg(y) if agg == "auto" else agg
    keys = [x] + ([color] if color and color != x else [])
    cond = None
    for k in keys:
        cond = F.col(k).isNotNull() if cond is None else cond & F.col(k).isNotNull()
    src = nan_to_null(df.select(*dict.fromkeys(keys + [y])), y).where(cond)
    if how == "median":
        # exact at any size; groups whose values are all NULL get NULL, as the other aggregates do
        med = grouped_quantiles(src, keys, y, [0.5], accuracy if accuracy else "auto").withColumnRenamed("q0", y)
        grouped = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).drop("_n").join(med, keys, "left").checkpoint()
    else:
        grouped = src.groupBy(*keys).agg(metric_agg(y, how, accuracy).alias(y))
    if not top_n:
        return grouped
    top_x = (grouped.groupBy(x).agg(F.sum(y).alias("_rank_total"))
                    .orderBy(F.col("_rank_total").desc_nulls_last(), F.col(x).asc())
                    .limit(int(top_n))
                    .select(x))
    return grouped.join(F.broadcast(top_x), on=x, how="left_semi")
