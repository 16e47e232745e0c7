"""Time series and process control: T1 trend, T2 forecast, T3 direction, T5 control chart,
T6 time to limit.

Period bucketing is a projection (``to_date``/``trunc``/``last_day``) followed by one grouped
aggregate; empty periods come from a calendar exploded from the one-row min/max and left-joined.
Regressions use ``regr_slope``/``regr_intercept`` (partial + final aggregates). The position
``t`` of a point is derived arithmetically when the series is regular, else by the distributed
ranking of :mod:`sheetwise.operators.sequence`.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetwise.functions.date_shapes import with_timestamp
from sheetwise.functions.missing import nan_to_null
from sheetwise.functions.naming import is_rate_like, require_columns
from sheetwise.operators.sequence import with_position

FREQS = ("D", "W", "M")


def _ts_lit(v) -> Column:
    """A TIMESTAMP_NTZ literal from a naive datetime, independent of any time zone."""
    return F.lit(v.isoformat(sep=" ")).cast("timestamp_ntz")


def _us(c: Column) -> Column:
    """Microseconds of a TIMESTAMP_NTZ on a zone-free axis (the session zone cancels out in
    differences)."""
    return F.unix_micros(c.cast("timestamp_ntz").cast("timestamp"))


def _period(ts: Column, freq: str) -> Column:
    d = F.to_date(ts)
    if freq == "D":
        return d
    if freq == "W":  # weeks end on Sunday and are labelled by that Sunday
        return F.date_add(F.trunc(d, "week"), 6)
    if freq == "M":  # labelled by the month's last day
        return F.last_day(d)
    raise ValueError(f"freq must be one of {FREQS}")


def _calendar(bounds: DataFrame, freq: str) -> DataFrame:
    """Every period label between the one-row ``lo``/``hi`` bounds, one row each."""
    if freq == "M":
        months = F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("INTERVAL 1 MONTH"))
        return bounds.select(F.explode(months).alias("m")).select(F.last_day("m").alias("period"))
    step = F.expr("INTERVAL 7 DAYS") if freq == "W" else F.expr("INTERVAL 1 DAY")
    return bounds.select(F.explode(F.sequence("lo", "hi", step)).alias("period"))


def time_trend(df: DataFrame, date_col: str, metric: str, freq: str = "D") -> DataFrame:
    """``[period, total]`` per day / week (ending Sunday) / month (month end), every period
    between the first and last one present. ``total`` is the sum (0 for an empty period) or,
    for rate-like metrics, the mean (NULL for an empty period). Rows with a NULL or unparseable
    date or a NULL metric are left out."""
    require_columns(df, date_col, metric)
    if freq not in FREQS:
        raise ValueError(f"freq must be one of {FREQS}")
    how = "mean" if is_rate_like(metric) else "sum"
    there = (nan_to_null(df.select(date_col, metric), metric)
               .where(F.col(date_col).isNotNull() & F.col(metric).isNotNull()))
    data = (with_timestamp(there, date_col)
              .select(_period(F.col(date_col), freq).alias("period"),
                      F.col(metric).cast("double").alias("m"))
              .where(F.col("period").isNotNull()))
    agg = F.sum("m") if how == "sum" else F.avg("m")
    # one row per period, read twice (bounds and totals): computed once
    grouped = data.groupBy("period").agg(agg.alias("total")).checkpoint()
    bounds = grouped.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    cal = _calendar(bounds, freq)
    total = F.coalesce(F.col("total"), F.lit(0.0)) if how == "sum" else F.col("total")
    return (cal.join(grouped, on="period", how="left")
               .select(F.col("period").cast("timestamp_ntz").alias("period"), total.alias("total"))
               .orderBy("period"))


# ---------------------------------------------------------------------------------------------
# T2 forecast
# ---------------------------------------------------------------------------------------------

def _business_days(lo: _dt.date, hi: _dt.date) -> int:
    """Weekdays (Monday-Friday) from ``lo`` to ``hi`` inclusive."""
    days = (hi - lo).days + 1
    full, rem = divmod(days, 7)
    start = lo.weekday()
    return full * 5 + sum(1 for i in range(rem) if (start + i) % 7 < 5)


def _infer_step(series: DataFrame, date_col: str, n: int, lo, hi) -> tuple[str, object]:
    """Regular spacing of the sorted distinct timestamps, decided by one aggregate:
    ('tick', microseconds) when all gaps are equal; ('ME'|'MS', m) for month ends / month starts
    every m months (monthly, quarterly, yearly...); ('B', None) for every business day between
    the first and last date; else ('D', None) (irregular: daily future, positions by ranking)."""
    span = int((hi - lo) / _dt.timedelta(microseconds=1))
    secs = _us(F.col(date_col)) - _us(_ts_lit(lo))
    month_idx = F.year(date_col) * 12 + F.month(date_col)
    lo_m, hi_m = lo.year * 12 + lo.month, hi.year * 12 + hi.month
    checks = [F.count_if(F.to_date(date_col) == F.last_day(date_col)).alias("n_end"),
              F.count_if(F.dayofmonth(date_col) == 1).alias("n_start"),
              F.count_if(F.col(date_col).cast("timestamp_ntz") != F.date_trunc("day", date_col).cast("timestamp_ntz")).alias("n_time"),
              F.count_distinct(month_idx).alias("n_months"),
              F.count_if(F.weekday(date_col) >= 5).alias("n_weekend")]
    step_us = None
    if n > 1 and span % (n - 1) == 0:
        step_us = span // (n - 1)
        checks.append(F.count_if((secs % F.lit(step_us)) != 0).alias("off_grid"))
    m_step = (hi_m - lo_m) // (n - 1) if n > 1 and (hi_m - lo_m) % (n - 1) == 0 and hi_m > lo_m else None
    if m_step:
        checks.append(F.count_if(((month_idx - F.lit(lo_m)) % F.lit(m_step)) != 0).alias("off_months"))
    r = series.agg(*checks).first()
    if step_us and r["off_grid"] == 0:
        return "tick", step_us
    if m_step and r["n_time"] == 0 and r["n_months"] == n and r["off_months"] == 0:
        if r["n_end"] == n:
            return "ME", m_step
        if r["n_start"] == n:
            return "MS", m_step
    if r["n_time"] == 0 and r["n_weekend"] == 0 and n == _business_days(lo.date(), hi.date()):
        return "B", None
    return "D", None


def forecast(df: DataFrame, date_col: str, value_col: str, periods: int = 30) -> dict | None:
    """T2 + T3: linear trend on the point position plus mean day-of-week residual (Monday = 0).

    Values are summed per timestamp first. Fewer than 5 points gives ``None``. Returns
    ``{"series": DataFrame[date_col, value_col, type, lower, upper], "meta": one-row DataFrame
    [slope, direction, freq, n_points, resid_std]}``; ``type`` is 'Actual' (lower = upper =
    value) or 'Forecast' (value -/+ 1.96 sample std of the trend residual)."""
    require_columns(df, date_col, value_col)
    spark = df.sparkSession
    series = (with_timestamp(nan_to_null(df.select(date_col, value_col), value_col), date_col)
                .select(date_col, F.col(value_col).cast("double").alias(value_col))
                .where(F.col(date_col).isNotNull() & F.col(value_col).isNotNull())
                .groupBy(date_col).agg(F.sum(value_col).alias(value_col)))
    # one row per distinct timestamp, read by several small passes below
    series = series.checkpoint()
    s = series.agg(F.count("*").alias("n"), F.min(date_col).alias("lo"), F.max(date_col).alias("hi")).first()
    n = s["n"]
    if n < 5:
        return None
    lo, hi = s["lo"], s["hi"]
    kind, step_us = _infer_step(series, date_col, n, lo, hi)
    if kind == "tick":
        t = F.floor((_us(F.col(date_col)) - _us(_ts_lit(lo))) / F.lit(step_us)).cast("long")
        positioned = series.withColumn("t", t)
    elif kind in ("ME", "MS"):
        positioned = series.withColumn(
            "t", ((F.year(date_col) * 12 + F.month(date_col) - (lo.year * 12 + lo.month)) / F.lit(step_us)).cast("long"))
    elif kind == "B":
        # every business day is present: the position is the count of weekdays since the first
        days = F.datediff(F.to_date(date_col), F.lit(lo.date()))
        rem = days % 7
        crossed = F.when(F.lit(lo.weekday()) + rem >= 5, F.lit(2)).otherwise(F.lit(0))
        positioned = series.withColumn("t", (F.floor(days / 7) * 5 + rem - crossed).cast("long"))
    else:
        positioned = with_position(series, [date_col], name="t")
    fit = positioned.agg(F.regr_slope(value_col, "t").alias("slope"),
                         F.regr_intercept(value_col, "t").alias("intercept")).first()
    slope, intercept = float(fit["slope"] or 0.0), float(fit["intercept"] or 0.0)
    resid = F.col(value_col) - (F.lit(slope) * F.col("t") + F.lit(intercept))
    by_dow = (positioned.groupBy(F.weekday(date_col).alias("dow"))
                        .agg(F.avg(resid).alias("mean_r"), F.count("*").alias("k"),
                             F.sum(resid * resid).alias("ss"), F.sum(resid).alias("sr"))
                        .collect())  # at most 7 rows
    seasonal = {r["dow"]: float(r["mean_r"]) for r in by_dow}
    ss = sum(r["ss"] for r in by_dow)
    sr = sum(r["sr"] for r in by_dow)
    var = max((ss - sr * sr / n) / (n - 1), 0.0) if n > 1 else 0.0
    resid_std = var ** 0.5

    k = F.col("id")
    if kind == "tick":
        fdate = F.timestamp_micros(_us(_ts_lit(hi)) + k * F.lit(step_us)).cast("timestamp_ntz")
    elif kind == "ME":
        fdate = F.last_day(F.add_months(F.to_date(_ts_lit(hi)), (k * step_us).cast("int"))).cast("timestamp_ntz")
    elif kind == "MS":
        fdate = F.add_months(F.to_date(_ts_lit(hi)), (k * step_us).cast("int")).cast("timestamp_ntz")
    elif kind == "B":
        full_weeks = F.floor((F.lit(hi.weekday()) + k) / 5)
        fdate = _ts_lit(hi) + F.make_dt_interval(days=(k + 2 * full_weeks).cast("int"))
    else:
        fdate = _ts_lit(hi) + F.make_dt_interval(days=k.cast("int"))
    season_map = F.create_map(*[x for d, v in sorted(seasonal.items()) for x in (F.lit(d), F.lit(v))])
    fval = (F.lit(slope) * (F.lit(n - 1) + k) + F.lit(intercept)
            + F.coalesce(F.element_at(season_map, F.weekday(F.col(date_col))), F.lit(0.0)))
    future = (spark.range(1, periods + 1, numPartitions=1)
                   .select(fdate.alias(date_col), "id")
                   .select(date_col, fval.alias(value_col))
                   .select(date_col, value_col, F.lit("Forecast").alias("type"),
                           (F.col(value_col) - 1.96 * resid_std).alias("lower"),
                           (F.col(value_col) + 1.96 * resid_std).alias("upper")))
    history = series.select(F.col(date_col).cast("timestamp_ntz").alias(date_col), value_col,
                            F.lit("Actual").alias("type"),
                            F.col(value_col).alias("lower"), F.col(value_col).alias("upper"))
    freq = {"tick": f"{step_us}us", "ME": f"{step_us}ME", "MS": f"{step_us}MS", "B": "B", "D": "D"}[kind]
    direction = trend_direction(slope)
    meta = spark.createDataFrame(
        [(slope, direction, freq, int(n), resid_std)],
        "slope double, direction string, freq string, n_points long, resid_std double")
    return {"series": history.unionByName(future), "meta": meta}


def unread_dates(df: DataFrame, date_col: str) -> DataFrame:
    """One row ``rows, unread``: how many rows have a date and how many of those are read neither by a listed
    pattern nor by shape (T1 and T2 leave them out)."""
    require_columns(df, date_col)
    dates = with_timestamp(df.where(F.col(date_col).isNotNull()).select(date_col), date_col)
    return dates.agg(F.count("*").alias("rows"), F.count_if(F.col(date_col).isNull()).alias("unread"))


def trend_direction(slope: float) -> str:
    """Increasing above 0.01, decreasing below -0.01, else flat."""
    return "increasing" if slope > 0.01 else ("decreasing" if slope < -0.01 else "flat")


# ---------------------------------------------------------------------------------------------
# T5 / T6 process control
# ---------------------------------------------------------------------------------------------

def control_chart(df: DataFrame, metric: str, sequence_col: str | None = None) -> dict[str, DataFrame]:
    """T5: individuals chart. Limits are mean -/+ 3 sample std (std 0 for one point); a point is
    in control when lcl <= value <= ucl (unrounded limits). ``summary`` has mean, std, ucl, lcl
    rounded to 4, out_of_control_count and out_of_control_pct (rounded to 1). ``points`` carries
    ``in_control`` per complete row, ordered by ``sequence_col`` when given.

    The limits are scalar subqueries over one aggregate; flagging is a projection (no shuffle)."""
    require_columns(df, metric)
    cols = [metric] + ([sequence_col] if sequence_col and sequence_col in df.columns else [])
    data = nan_to_null(df.select(*cols)).dropna()
    lims = data.agg(F.coalesce(F.avg(metric), F.lit(0.0)).alias("mean"),
                    F.when(F.count(metric) > 1, F.stddev_samp(metric)).otherwise(F.lit(0.0)).alias("std"))
    lims = lims.select("mean", "std", (F.col("mean") + 3 * F.col("std")).alias("ucl"),
                       (F.col("mean") - 3 * F.col("std")).alias("lcl"))
    ucl, lcl = lims.select("ucl").scalar(), lims.select("lcl").scalar()
    points = data.withColumn("in_control", F.col(metric).between(lcl, ucl))
    if len(cols) > 1:
        points = points.orderBy(sequence_col)
    mean, std = lims.select("mean").scalar(), lims.select("std").scalar()
    summary = (points.agg(F.count("*").alias("n"), F.count_if(~F.col("in_control")).alias("out"))
                     .select(F.bround(mean, 4).alias("mean"), F.bround(std, 4).alias("std"),
                             F.bround(ucl, 4).alias("ucl"), F.bround(lcl, 4).alias("lcl"),
                             F.col("out").alias("out_of_control_count"),
                             F.when(F.col("n") > 0, F.bround(F.col("out") / F.col("n") * 100, 1))
                              .otherwise(F.lit(0.0)).alias("out_of_control_pct")))
    return {"summary": summary, "points": points, "limits": lims}


def time_to_limit(points: DataFrame, metric: str, order_cols: list[str], ucl, lcl) -> DataFrame:
    """One row ``slope, trend, heading_toward, periods_to_breach, current_value``.

    OLS of the metric on its position in ``order_cols`` order; |slope| < 1e-9 is 'stable';
    a rising series heads to ``ucl``, a falling one to ``lcl``; periods = (limit - last)/slope,
    NULL when negative. Raises ValueError below 5 points. ``ucl``/``lcl`` may be numbers or
    one-value Columns (e.g. scalar subqueries of :func:`control_chart`'s ``limits``)."""
    require_columns(points, metric, *order_cols)
    data = nan_to_null(points.select(*dict.fromkeys([*order_cols, metric])), metric).where(F.col(metric).isNotNull())
    pos = with_position(data, list(order_cols), name="t")
    fit = pos.agg(F.count("*").alias("n"), F.regr_slope(metric, "t").alias("b"),
                  F.max_by(F.col(metric), F.col("t")).cast("double").alias("cur"))
    if fit.select("n").first()[0] < 5:
        raise ValueError("a trend takes five points or more")
    u = ucl if isinstance(ucl, Column) else F.lit(float(ucl))
    low = lcl if isinstance(lcl, Column) else F.lit(float(lcl))
    b = F.coalesce(F.col("b"), F.lit(0.0))
    stable = F.abs(b) < 1e-9
    target = F.when(b > 0, u).otherwise(low)
    periods = F.try_divide(target - F.col("cur"), b)
    return fit.select(
        F.when(stable, F.lit(0.0)).otherwise(F.bround(b, 6)).alias("slope"),
        F.when(stable, "stable").when(b > 0, "increasing").otherwise("decreasing").alias("trend"),
        F.when(stable, F.lit(None).cast("string"))
         .when(b > 0, "upper control limit").otherwise("lower control limit").alias("heading_toward"),
        F.when(stable | (periods < 0), F.lit(None).cast("double"))
         .otherwise(F.bround(periods, 1)).alias("periods_to_breach"),
        F.bround("cur", 4).alias("current_value"))
