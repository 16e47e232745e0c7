"""Registered test-data queries: each runs one operator over whole given tables.

Every entry pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with, where the operator is
expressible in SQL, the same computation as DuckDB SQL over the same parquet tables. Computed
columns carry the same names on both sides. Floating-point results that come out of long sums
are rounded (half to even on both sides) to a precision well above their summation noise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.functions import date_shapes as DS
from sheetwise.functions.dates import parse_timestamp
from sheetwise.operators import aggregate as G
from sheetwise.operators import timeseries as TS
from sheetwise.operators import usage as U
from sheetwise.plans.tables import api_calls, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def _r(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.bround(F.col(c), digits))
    return df


# ---------------------------------------------------------------------------------------------
# G: rankings and shares
# ---------------------------------------------------------------------------------------------

def brand_revenue_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per part summed before the join (a sum of sums is the sum): the join then sees
    one row per part instead of one per line item, and it reuses the aggregate's hash
    partitioning on the part key, so only ``part`` is shuffled for it (or broadcast by AQE when
    its measured size is under the threshold)."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    per_part = li.groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("l_extendedprice"))
    return per_part.join(part, per_part.l_partkey == part.p_partkey).select("p_brand", "l_extendedprice")


def parts_with_unit_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` with the retail price under a rate-like name. The name rule splits only on
    separators and camelCase, so ``p_retailprice`` is summed; ``retail_price`` is averaged."""
    return table(spark, sf_dir, "part").withColumnRenamed("p_retailprice", "retail_price")


@register("g1_top_brands_by_revenue", """
WITH g AS (
  SELECT p_brand, CAST(COALESCE(SUM(l_extendedprice), 0) AS DOUBLE) AS total
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE p_brand IS NOT NULL GROUP BY p_brand),
s AS (SELECT SUM(total) AS grand FROM g)
SELECT p_brand, round_even(total, 2) AS total,
       CASE WHEN grand <> 0 THEN round_even(total / grand * 100, 1) ELSE 0.0 END AS share_pct
FROM g, s ORDER BY g.total DESC, p_brand LIMIT 10
""")
def q_g1(spark, sf_dir):
    return _r(G.top_performers(brand_revenue_input(spark, sf_dir), "p_brand", "l_extendedprice", 10),
              2, "total")


@register("g1_top_brands_by_mean_retailprice", """
WITH g AS (SELECT p_brand, AVG(p_retailprice) AS total FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand),
s AS (SELECT SUM(total) AS grand FROM g)
SELECT p_brand, round_even(total, 4) AS total,
       CASE WHEN grand <> 0 THEN round_even(total / grand * 100, 1) ELSE 0.0 END AS share_pct
FROM g, s ORDER BY g.total DESC, p_brand LIMIT 5
""")
def q_g1_rate(spark, sf_dir):
    return _r(G.top_performers(parts_with_unit_price(spark, sf_dir), "p_brand", "retail_price", 5), 4, "total")


@register("g2_concentration_by_order_priority", """
WITH g AS (SELECT o_orderpriority, CAST(COALESCE(SUM(o_totalprice), 0) AS DOUBLE) AS total
           FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority),
s AS (SELECT SUM(total) AS grand FROM g),
h AS (SELECT SUM((total / grand) * (total / grand)) AS hhi FROM g, s),
t AS (SELECT o_orderpriority AS top_category, total AS top_total FROM g ORDER BY total DESC, o_orderpriority LIMIT 1)
SELECT round_even(hhi, 4) AS hhi,
       CASE WHEN hhi < 0.15 THEN 'Low' WHEN hhi < 0.25 THEN 'Moderate' ELSE 'High' END AS risk_level,
       top_category,
       CASE WHEN grand <> 0 THEN round_even(top_total / grand * 100, 1) ELSE 0.0 END AS top_category_share_pct
FROM h, t, s
""")
def q_g2(spark, sf_dir):
    return G.concentration_risk(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")["summary"]


@register("g2_breakdown_by_nation", """
WITH g AS (SELECT c_nationkey, CAST(COALESCE(SUM(c_acctbal), 0) AS DOUBLE) AS total
           FROM customer WHERE c_nationkey IS NOT NULL GROUP BY c_nationkey),
s AS (SELECT SUM(total) AS grand FROM g)
SELECT c_nationkey, round_even(total, 2) AS total, round_even(total / grand, 6) AS share FROM g, s
""")
def q_g2_breakdown(spark, sf_dir):
    out = G.concentration_risk(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal")["breakdown"]
    return _r(_r(out, 2, "total"), 6, "share")


@register("g3_kpi_customer_segment_balance", """
WITH g AS (SELECT c_mktsegment, CAST(COALESCE(SUM(c_acctbal), 0) AS DOUBLE) AS total
           FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment),
s AS (SELECT SUM(total) AS gs, COUNT(*) AS cc FROM g),
t AS (SELECT c_mktsegment AS top_category, total AS top_total FROM g ORDER BY total DESC, c_mktsegment LIMIT 1)
SELECT round_even(gs, 2) AS total, cc AS category_count, top_category,
       CASE WHEN gs <> 0 THEN round_even(top_total / gs * 100, 1) ELSE 0.0 END AS top_category_share_pct,
       round_even(gs / cc, 2) AS avg_per_category, 'sum' AS agg
FROM s, t
""")
def q_g3(spark, sf_dir):
    return G.kpi_summary(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")


@register("g3_kpi_part_brand_retailprice", """
WITH g AS (SELECT p_brand, AVG(p_retailprice) AS total FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand),
s AS (SELECT SUM(total) AS gs, COUNT(*) AS cc FROM g),
m AS (SELECT AVG(p_retailprice) AS row_mean FROM part),
t AS (SELECT p_brand AS top_category, total AS top_total FROM g ORDER BY total DESC, p_brand LIMIT 1)
SELECT round_even(row_mean, 2) AS total, cc AS category_count, top_category,
       CASE WHEN gs <> 0 THEN round_even(top_total / gs * 100, 1) ELSE 0.0 END AS top_category_share_pct,
       round_even(gs / cc, 2) AS avg_per_category, 'mean' AS agg
FROM s, t, m
""")
def q_g3_rate(spark, sf_dir):
    return G.kpi_summary(parts_with_unit_price(spark, sf_dir), "p_brand", "retail_price")


@register("g4_chart_mean_retailprice_top15_brands", """
WITH g AS (SELECT p_brand, AVG(p_retailprice) AS retail_price FROM part
           WHERE p_brand IS NOT NULL GROUP BY p_brand),
top AS (SELECT p_brand FROM g ORDER BY retail_price DESC, p_brand LIMIT 15)
SELECT p_brand, round_even(retail_price, 4) AS retail_price FROM g WHERE p_brand IN (SELECT p_brand FROM top)
""")
def q_g4(spark, sf_dir):
    out = G.chart_aggregate(parts_with_unit_price(spark, sf_dir), "p_brand", "retail_price", top_n=15)
    return _r(out, 4, "retail_price")


@register("g4_chart_median_price_by_flag_status", """
WITH g AS (SELECT l_returnflag, l_linestatus, CAST(quantile_cont(l_extendedprice, 0.5) AS DOUBLE) AS l_extendedprice
           FROM lineitem WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL
           GROUP BY l_returnflag, l_linestatus),
top AS (SELECT l_returnflag FROM g GROUP BY l_returnflag ORDER BY SUM(l_extendedprice) DESC, l_returnflag LIMIT 2)
SELECT l_returnflag, l_linestatus, round_even(l_extendedprice, 4) AS l_extendedprice
FROM g WHERE l_returnflag IN (SELECT l_returnflag FROM top)
""")
def q_g4_median(spark, sf_dir):
    out = G.chart_aggregate(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice",
                            color="l_linestatus", agg="median", top_n=2)
    return _r(out, 4, "l_extendedprice")


@register("g4_chart_count_quantity_by_nation_segment", """
SELECT c_nationkey, c_mktsegment, COUNT(c_acctbal) AS c_acctbal FROM customer
WHERE c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL GROUP BY c_nationkey, c_mktsegment
""")
def q_g4_count(spark, sf_dir):
    return G.chart_aggregate(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal",
                             color="c_mktsegment", agg="count")


# ---------------------------------------------------------------------------------------------
# U: usage reports over the event log
# ---------------------------------------------------------------------------------------------

@register("u1_events_by_type", "SELECT event_type, COUNT(*) AS events FROM events GROUP BY event_type")
def q_u1(spark, sf_dir):
    return U.events_by(table(spark, sf_dir, "events"), "event_type")


@register("u2_usage_totals", """
SELECT COUNT(DISTINCT user_id) AS sessions, COUNT(*) FILTER (WHERE event_type = 'error') AS errors,
       COUNT(*) AS events FROM events
""")
def q_u2(spark, sf_dir):
    return U.usage_totals(table(spark, sf_dir, "events"), session="user_id")


@register("u3_daily_activity", """
SELECT CAST(ts AS DATE) AS day, COUNT(*) AS events, COUNT(DISTINCT user_id) AS sessions
FROM events GROUP BY 1 ORDER BY 1
""")
def q_u3(spark, sf_dir):
    return U.activity_over_time(table(spark, sf_dir, "events"), ts="ts", session="user_id")


@register("u4_api_cost_by_model", """
WITH c AS (SELECT role AS model,
                  CASE WHEN role <> 'assistant' THEN length(text) END AS input_tokens,
                  CASE WHEN role = 'assistant' THEN length(text) END AS output_tokens
           FROM conversations),
g AS (SELECT model, COUNT(*) AS calls, CAST(COALESCE(SUM(input_tokens), 0) AS BIGINT) AS input_tokens,
             CAST(COALESCE(SUM(output_tokens), 0) AS BIGINT) AS output_tokens FROM c GROUP BY model)
SELECT COALESCE(model, 'unknown') AS model, calls, input_tokens, output_tokens,
       round_even(input_tokens / 1000000.0 * 3.0 + output_tokens / 1000000.0 * 15.0, 4) AS est_cost_usd
FROM g
""")
def q_u4(spark, sf_dir):
    return U.api_cost_estimate(api_calls(spark, sf_dir))["breakdown"]


@register("u5_recent_events", """
SELECT ts, user_id, event_type, props FROM events ORDER BY event_id DESC LIMIT 100
""")
def q_u5(spark, sf_dir):
    return U.recent_events(table(spark, sf_dir, "events"), 100, order_by="event_id",
                           columns=["ts", "user_id", "event_type", "props"])


# ---------------------------------------------------------------------------------------------
# T: time series and process control
# ---------------------------------------------------------------------------------------------

_TREND_SQL = """
WITH d AS (SELECT {period} AS period, o_totalprice AS m FROM orders
           WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL),
g AS (SELECT period, SUM(m) AS total FROM d GROUP BY period),
b AS (SELECT MIN(period) AS lo, MAX(period) AS hi FROM g),
cal AS (SELECT {label} AS period FROM b, generate_series({gen_lo}, {gen_hi}, INTERVAL {step}) AS s(p))
SELECT CAST(cal.period AS TIMESTAMP) AS period, round_even(COALESCE(g.total, 0.0), 2) AS total
FROM cal LEFT JOIN g ON cal.period = g.period
"""


@register("t1_orders_daily_revenue", _TREND_SQL.format(
    period="CAST(o_orderdate AS DATE)", label="CAST(p AS DATE)", gen_lo="CAST(lo AS TIMESTAMP)",
    gen_hi="CAST(hi AS TIMESTAMP)", step="1 DAY"))
def q_t1_daily(spark, sf_dir):
    return _r(TS.time_trend(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "D"), 2, "total")


@register("t1_orders_weekly_revenue", _TREND_SQL.format(
    period="CAST(date_trunc('week', o_orderdate) AS DATE) + 6", label="CAST(p AS DATE)",
    gen_lo="CAST(lo AS TIMESTAMP)", gen_hi="CAST(hi AS TIMESTAMP)", step="7 DAY"))
def q_t1_weekly(spark, sf_dir):
    return _r(TS.time_trend(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "W"), 2, "total")


@register("t1_orders_monthly_revenue", _TREND_SQL.format(
    period="last_day(o_orderdate)", label="last_day(p)",
    gen_lo="CAST(date_trunc('month', lo) AS TIMESTAMP)", gen_hi="CAST(date_trunc('month', hi) AS TIMESTAMP)",
    step="1 MONTH"))
def q_t1_monthly(spark, sf_dir):
    return _r(TS.time_trend(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "M"), 2, "total")


@register("t1_lineitem_monthly_mean_discount_rate", """
WITH d AS (SELECT last_day(l_shipdate) AS period, l_discount AS m FROM lineitem
           WHERE l_shipdate IS NOT NULL AND l_discount IS NOT NULL),
g AS (SELECT period, AVG(m) AS total FROM d GROUP BY period),
b AS (SELECT MIN(period) AS lo, MAX(period) AS hi FROM g),
cal AS (SELECT last_day(p) AS period FROM b,
        generate_series(CAST(date_trunc('month', lo) AS TIMESTAMP), CAST(date_trunc('month', hi) AS TIMESTAMP), INTERVAL 1 MONTH) AS s(p))
SELECT CAST(cal.period AS TIMESTAMP) AS period, round_even(g.total, 6) AS total
FROM cal LEFT JOIN g ON cal.period = g.period
""")
def q_t1_rate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_discount", "discount_rate")
    out = TS.time_trend(li, "l_shipdate", "discount_rate", "M")
    return _r(out, 6, "total")


@register("t2_forecast_orders_daily_revenue", """
WITH s AS (SELECT o_orderdate, SUM(o_totalprice) AS o_totalprice FROM orders
           WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY o_orderdate),
p AS (SELECT *, row_number() OVER (ORDER BY o_orderdate) - 1 AS t FROM s),
f AS (SELECT regr_slope(o_totalprice, t) AS b, regr_intercept(o_totalprice, t) AS a,
             COUNT(*) AS n, MAX(o_orderdate) AS hi FROM p),
r AS (SELECT o_totalprice - (b * t + a) AS resid, isodow(o_orderdate) - 1 AS dow FROM p, f),
sea AS (SELECT dow, AVG(resid) AS m FROM r GROUP BY dow),
sd AS (SELECT stddev_samp(resid) AS sd FROM r),
fut AS (SELECT hi + k * INTERVAL 1 DAY AS o_orderdate, b * (n - 1 + k) + a AS v FROM f, range(1, 31) AS g(k)),
fv AS (SELECT fut.o_orderdate, v + COALESCE(sea.m, 0.0) AS v FROM fut
       LEFT JOIN sea ON isodow(fut.o_orderdate) - 1 = sea.dow)
SELECT o_orderdate, round_even(o_totalprice, 2) AS o_totalprice, 'Actual' AS type,
       round_even(o_totalprice, 2) AS lower, round_even(o_totalprice, 2) AS upper FROM s
UNION ALL
SELECT o_orderdate, round_even(v, 2), 'Forecast', round_even(v - 1.96 * sd, 2), round_even(v + 1.96 * sd, 2)
FROM fv, sd
""")
def q_t2(spark, sf_dir):
    out = TS.forecast(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", 30)["series"]
    return _r(out, 2, "o_totalprice", "lower", "upper")


@register("t3_forecast_direction", """
WITH s AS (SELECT o_orderdate, SUM(o_totalprice) AS v FROM orders
           WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY o_orderdate),
p AS (SELECT v, row_number() OVER (ORDER BY o_orderdate) - 1 AS t FROM s),
f AS (SELECT regr_slope(v, t) AS b FROM p)
SELECT CASE WHEN b > 0.01 THEN 'increasing' WHEN b < -0.01 THEN 'decreasing' ELSE 'flat' END AS direction
FROM f
""")
def q_t3(spark, sf_dir):
    meta = TS.forecast(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", 30)["meta"]
    return meta.select("direction")


_CC_SQL = """
WITH d AS (SELECT l_extendedprice, l_shipdate FROM lineitem
           WHERE l_extendedprice IS NOT NULL AND l_shipdate IS NOT NULL),
l AS (SELECT AVG(l_extendedprice) AS mean,
             CASE WHEN COUNT(*) > 1 THEN stddev_samp(l_extendedprice) ELSE 0.0 END AS std FROM d)
"""


@register("t5_control_chart_summary", _CC_SQL + """
SELECT round_even(mean, 4) AS mean, round_even(std, 4) AS std, round_even(mean + 3 * std, 4) AS ucl,
       round_even(mean - 3 * std, 4) AS lcl,
       COUNT(*) FILTER (WHERE NOT (l_extendedprice BETWEEN mean - 3 * std AND mean + 3 * std)) AS out_of_control_count,
       round_even(COUNT(*) FILTER (WHERE NOT (l_extendedprice BETWEEN mean - 3 * std AND mean + 3 * std)) * 100.0 / COUNT(*), 1) AS out_of_control_pct
FROM d, l GROUP BY mean, std
""")
def q_t5(spark, sf_dir):
    return TS.control_chart(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_shipdate")["summary"]


@register("t5_control_chart_points", _CC_SQL + """
SELECT l_extendedprice, l_shipdate,
       l_extendedprice BETWEEN mean - 3 * std AND mean + 3 * std AS in_control
FROM d, l
""")
def q_t5_points(spark, sf_dir):
    return TS.control_chart(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_shipdate")["points"]


@register("t6_time_to_limit_extendedprice", """
WITH d AS (SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice IS NOT NULL),
l AS (SELECT AVG(l_extendedprice) + 3 * stddev_samp(l_extendedprice) AS ucl,
             AVG(l_extendedprice) - 3 * stddev_samp(l_extendedprice) AS lcl FROM d),
p AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS t FROM d),
f AS (SELECT regr_slope(v, t) AS b, arg_max(v, t) AS cur FROM p)
SELECT CASE WHEN abs(b) < 1e-9 THEN 0.0 ELSE round_even(b, 6) END AS slope,
       CASE WHEN abs(b) < 1e-9 THEN 'stable' WHEN b > 0 THEN 'increasing' ELSE 'decreasing' END AS trend,
       CASE WHEN abs(b) < 1e-9 THEN NULL WHEN b > 0 THEN 'upper control limit' ELSE 'lower control limit' END AS heading_toward,
       CASE WHEN abs(b) < 1e-9 THEN NULL
            WHEN ((CASE WHEN b > 0 THEN ucl ELSE lcl END) - cur) / b < 0 THEN NULL
            ELSE round_even(((CASE WHEN b > 0 THEN ucl ELSE lcl END) - cur) / b, 1) END AS periods_to_breach,
       round_even(cur, 4) AS current_value
FROM f, l
""")
def q_t6(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    lims = TS.control_chart(li, "l_extendedprice")["limits"]
    # (order key, line number) repeats in this data; the price completes the order, so the
    # sequence of values is fully defined.
    return TS.time_to_limit(li, "l_extendedprice", ["l_orderkey", "l_linenumber", "l_extendedprice"],
                            lims.select("ucl").scalar(), lims.select("lcl").scalar())


# ---------------------------------------------------------------------------------------------
# P: profiling and column roles
# ---------------------------------------------------------------------------------------------

from sheetwise.operators import clean as C  # noqa: E402
from sheetwise.operators import profile as P  # noqa: E402
from sheetwise.plans.tables import MESSY_LINEITEM_SQL, messy_lineitem  # noqa: E402

_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
           "l_discount", "l_tax"]


def _stats_sql(table_name: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", round_even(CAST(COUNT({c}) AS DOUBLE), 3) AS count, "
            f"round_even(AVG({x}), 3) AS mean, round_even(stddev_samp({x}), 3) AS std, "
            f"round_even(MIN({x}), 3) AS min, round_even(quantile_cont({x}, 0.25), 3) AS p25, "
            f"round_even(quantile_cont({x}, 0.5), 3) AS p50, round_even(quantile_cont({x}, 0.75), 3) AS p75, "
            f"round_even(MAX({x}), 3) AS max FROM {table_name}")
    return "\nUNION ALL\n".join(parts)


@register("p1_stats_lineitem", _stats_sql("lineitem", _LI_NUM))
def q_p1(spark, sf_dir):
    return P.compute_stats(table(spark, sf_dir, "lineitem"))


def _corr_sql(table_name: str, cols: list[str]) -> str:
    parts = []
    for a in cols:
        for b in cols:
            xa, xb = f"CAST({a} AS DOUBLE)", f"CAST({b} AS DOUBLE)"
            parts.append(
                f"SELECT '{a}' AS x, '{b}' AS y, round_even(covar_pop({xa}, {xb}) / "
                f"NULLIF(stddev_pop({xa}) * stddev_pop({xb}), 0), 2) + 0.0 AS r FROM {table_name} "
                f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL")
    return "\nUNION ALL\n".join(parts)


@register("p2_correlations_lineitem", _corr_sql("lineitem", _LI_NUM))
def q_p2(spark, sf_dir):
    return P.correlations(table(spark, sf_dir, "lineitem"))


@register("p3_category_breakdown_part_brand", """
SELECT p_brand, COUNT(*) AS count FROM part WHERE p_brand IS NOT NULL
GROUP BY p_brand ORDER BY count DESC, p_brand LIMIT 15
""")
def q_p3(spark, sf_dir):
    return P.category_breakdown(table(spark, sf_dir, "part"), "p_brand", 15)


@register("p4_histogram_extendedprice", """
WITH d AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem WHERE l_extendedprice IS NOT NULL AND NOT isnan(l_extendedprice)),
b AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM d),
w AS (SELECT lo, hi, CASE WHEN hi > lo THEN (hi - lo) / 40 ELSE 1.0 END AS w FROM b),
c AS (SELECT LEAST(CAST(floor((x - lo) / w) AS INTEGER), 39) AS bin, COUNT(*) AS n FROM d, w GROUP BY 1)
SELECT s.bin AS bin, round_even(lo + s.bin * w, 4) AS lo, round_even(lo + (s.bin + 1) * w, 4) AS hi,
       COALESCE(c.n, 0) AS count
FROM w, range(0, 40) AS s(bin) LEFT JOIN c ON c.bin = s.bin
""")
def q_p4(spark, sf_dir):
    out = P.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 40)
    return _r(out.withColumn("bin", F.col("bin").cast("long")), 4, "lo", "hi")


@register("p5_box_extendedprice_by_returnflag", """
WITH d AS (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS v FROM lineitem
           WHERE l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL),
q AS (SELECT l_returnflag, COUNT(*) AS n, MIN(v) AS min, quantile_cont(v, 0.25) AS q1,
             quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3, MAX(v) AS max
      FROM d GROUP BY l_returnflag),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT f.l_returnflag, n, min, round_even(q1, 4) AS q1, round_even(median, 4) AS median, round_even(q3, 4) AS q3,
       max, round_even(lower_fence, 5) AS lower_fence, round_even(upper_fence, 5) AS upper_fence,
       MIN(v) FILTER (WHERE v BETWEEN lower_fence AND upper_fence) AS whisker_low,
       MAX(v) FILTER (WHERE v BETWEEN lower_fence AND upper_fence) AS whisker_high,
       COUNT(*) FILTER (WHERE NOT (v BETWEEN lower_fence AND upper_fence)) AS outliers
FROM f JOIN d ON d.l_returnflag = f.l_returnflag
GROUP BY ALL
""")
def q_p5(spark, sf_dir):
    out = P.box_summary(table(spark, sf_dir, "lineitem"), "l_extendedprice", by="l_returnflag")
    # quartiles of 2-decimal prices have at most 4 decimals, fences at most 5: no rounding ties
    return _r(_r(out, 4, "q1", "median", "q3"), 5, "lower_fence", "upper_fence")


@register("p5_box_quantity_overall", """
WITH d AS (SELECT CAST(l_quantity AS DOUBLE) AS v FROM lineitem WHERE l_quantity IS NOT NULL),
f AS (SELECT COUNT(*) AS n, MIN(v) AS min, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3, MAX(v) AS max FROM d),
g AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM f)
SELECT n, min, round_even(q1, 4) AS q1, round_even(median, 4) AS median, round_even(q3, 4) AS q3, max,
       round_even(lower_fence, 5) AS lower_fence, round_even(upper_fence, 5) AS upper_fence,
       MIN(v) FILTER (WHERE v BETWEEN lower_fence AND upper_fence) AS whisker_low,
       MAX(v) FILTER (WHERE v BETWEEN lower_fence AND upper_fence) AS whisker_high,
       COUNT(*) FILTER (WHERE NOT (v BETWEEN lower_fence AND upper_fence)) AS outliers
FROM g, d GROUP BY ALL
""")
def q_p5_overall(spark, sf_dir):
    out = P.box_summary(table(spark, sf_dir, "lineitem"), "l_quantity")
    return _r(_r(out, 4, "q1", "median", "q3"), 5, "lower_fence", "upper_fence")


def _numprof_sql(table_name: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS \"column\", round_even(AVG({x}), 2) AS mean, round_even(MIN({x}), 2) AS min, "
            f"round_even(MAX({x}), 2) AS max, round_even(stddev_samp({x}), 2) AS std, "
            f"round_even(SUM({x}), 2) AS sum, COUNT({x}) AS count FROM {table_name}")
    return "\nUNION ALL\n".join(parts)


@register("p6_numeric_profile_lineitem", _numprof_sql("lineitem", _LI_NUM))
def q_p6(spark, sf_dir):
    return P.numeric_profile(table(spark, sf_dir, "lineitem"))


@register("p6_category_profile_orders", """
WITH l AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders
           UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
c AS (SELECT "column", value, COUNT(*) AS count FROM l WHERE value IS NOT NULL GROUP BY ALL)
SELECT "column", value, count, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM c)
WHERE rank <= 5
""")
def q_p6_cat(spark, sf_dir):
    return P.category_profile(table(spark, sf_dir, "orders"))


def _sample_sql(table_name: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(rn AS INTEGER) AS rank, CAST(v AS VARCHAR) AS value FROM ("
            f"SELECT v, row_number() OVER (ORDER BY v) AS rn FROM (SELECT DISTINCT {c} AS v FROM {table_name} "
            f"WHERE {c} IS NOT NULL)) WHERE rn <= 3")
    return "\nUNION ALL\n".join(parts)


@register("p7_sample_values_part", _sample_sql(
    "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]))
def q_p7(spark, sf_dir):
    return P.sample_values(table(spark, sf_dir, "part"), 3)


@register("p8_roles_customer", """
WITH c AS (
  SELECT COUNT(DISTINCT c_name) AS d_name, COUNT(DISTINCT c_mktsegment) AS d_seg,
         COUNT(DISTINCT c_custkey) * 1.0 / COUNT(c_custkey) AS r_cust,
         COUNT(DISTINCT c_nationkey) * 1.0 / COUNT(c_nationkey) AS r_nation,
         COUNT(DISTINCT c_acctbal) * 1.0 / COUNT(c_acctbal) AS r_bal FROM customer)
SELECT
  CASE WHEN d_name BETWEEN 2 AND 50 AND (d_seg NOT BETWEEN 2 AND 50 OR d_name >= d_seg) THEN 'c_name'
       WHEN d_seg BETWEEN 2 AND 50 THEN 'c_mktsegment' ELSE 'c_name' END AS category,
  CASE WHEN r_cust <= 0.95 THEN 'c_custkey' WHEN r_nation <= 0.95 THEN 'c_nationkey'
       WHEN r_bal <= 0.95 THEN 'c_acctbal' ELSE 'c_custkey' END AS metric
FROM c
""")
def q_p8(spark, sf_dir):
    roles = P.suggest_roles(table(spark, sf_dir, "customer"))
    return spark.createDataFrame([(roles["category"], roles["metric"])], "category string, metric string")


def _flags_sql(table_name: str, cols: list[tuple[str, bool]]) -> str:
    parts = []
    for c, is_cat in cols:
        ident = "true" if P.N.has_identifier_name(c) else \
            f"COUNT(DISTINCT {c}) * 1.0 / NULLIF(COUNT({c}), 0) > 0.95"
        binary = f"COUNT(DISTINCT {c}) = 2" if is_cat else "false"
        parts.append(f"SELECT '{c}' AS \"column\", COALESCE({ident}, false) AS is_identifier, "
                     f"{binary} AS is_binary FROM {table_name}")
    return "\nUNION ALL\n".join(parts)


@register("p9_p11_column_flags_orders", _flags_sql("orders", [
    ("o_orderstatus", True), ("o_orderpriority", True), ("o_orderkey", False), ("o_custkey", False),
    ("o_totalprice", False)]))
def q_p9(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    roles = P.suggest_roles(orders)
    rows = []
    for r in roles["cardinality"].collect():
        is_cat = r["column"] in P.N.category_columns(orders)
        rows.append((r["column"], P.looks_like_identifier(r["column"], r["n_distinct"], r["n_nonnull"]),
                     r["column"] in roles["binary"] if is_cat else False))
    return spark.createDataFrame(rows, "column string, is_identifier boolean, is_binary boolean")


@register("p16_relabel_customer", """
SELECT c_custkey AS "C Custkey", c_name AS "C Name", c_nationkey AS "C Nationkey",
       c_acctbal AS "C Acctbal", c_mktsegment AS "C Mktsegment" FROM customer
""")
def q_p16(spark, sf_dir):
    return P.relabel(table(spark, sf_dir, "customer"))


# ---------------------------------------------------------------------------------------------
# C: cleaning, on the spreadsheet-like rewrite of lineitem
# ---------------------------------------------------------------------------------------------

_CLEAN_CTE = "WITH " + MESSY_LINEITEM_SQL.strip() + """,
d AS (SELECT DISTINCT * FROM messy),
t AS (SELECT l_orderkey, l_linenumber,
        CAST(replace(replace(price_text, '$', ''), ',', '') AS DOUBLE) AS "price_text (USD)",
        CAST(replace(discount_text, '%', '') AS DOUBLE) AS "discount_text (%)",
        CASE lower(trim(returned)) WHEN 'yes' THEN true WHEN 'no' THEN false END AS returned,
        ship_text, status, qty, part_ref FROM d)
"""


@register("c12_clean_messy_lineitem", _CLEAN_CTE + """,
med AS (SELECT median("price_text (USD)") AS mp, median("discount_text (%)") AS md, median(qty) AS mq,
               COUNT(*) FILTER (WHERE returned) AS bt, COUNT(*) FILTER (WHERE NOT returned) AS bf FROM t),
ms AS (SELECT ship_text AS v FROM t WHERE ship_text IS NOT NULL GROUP BY ship_text ORDER BY COUNT(*) DESC, ship_text LIMIT 1),
mt AS (SELECT status AS v FROM t WHERE status IS NOT NULL GROUP BY status ORDER BY COUNT(*) DESC, status LIMIT 1)
SELECT l_orderkey, l_linenumber,
       round_even(COALESCE("price_text (USD)", mp), 4) AS "price_text (USD)",
       round_even(COALESCE("discount_text (%)", md), 4) AS "discount_text (%)",
       COALESCE(returned, bt > bf) AS returned,
       strptime(COALESCE(ship_text, ms.v), '%d/%m/%Y') AS ship_text,
       COALESCE(status, mt.v) AS status, round_even(COALESCE(qty, mq), 4) AS qty, part_ref
FROM t, med, ms, mt
""")
def q_c12(spark, sf_dir):
    cleaned, _, _ = C.clean(messy_lineitem(spark, sf_dir))
    # an even-count median is computed as a + (b - a) / 2 here and (a + b) / 2 in DuckDB: equal
    # values that may differ in the last bit; 4 decimals is above the data's own precision
    return _r(cleaned, 4, "price_text (USD)", "discount_text (%)", "qty")


@register("c12_clean_report_counts", _CLEAN_CTE + """
SELECT (SELECT COUNT(*) FROM messy) AS original_rows, 9 AS original_cols,
       (SELECT COUNT(*) FROM messy) - (SELECT COUNT(*) FROM d) AS duplicates_removed,
       (SELECT COUNT(*) - COUNT("price_text (USD)") + COUNT(*) - COUNT("discount_text (%)")
             + COUNT(*) - COUNT(returned) + COUNT(*) - COUNT(ship_text) + COUNT(*) - COUNT(status)
             + COUNT(*) - COUNT(qty) + COUNT(*) - COUNT(part_ref) + COUNT(*) - COUNT(l_orderkey)
             + COUNT(*) - COUNT(l_linenumber) FROM t) AS total_missing,
       (SELECT COUNT(*) FROM d) AS cleaned_rows
""")
def q_c12_report(spark, sf_dir):
    _, report_df, _ = C.clean(messy_lineitem(spark, sf_dir))
    return report_df.select("original_rows", F.col("original_cols").cast("int"), "duplicates_removed",
                            "total_missing", "cleaned_rows")


@register("c1_duplicates_lineitem_whole_rows", """
SELECT COUNT(*) + COUNT(*) FILTER (WHERE l_returnflag = 'R') AS rows_before,
       (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM lineitem)) AS rows_after,
       COUNT(*) + COUNT(*) FILTER (WHERE l_returnflag = 'R')
         - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicates_removed
FROM lineitem
""")
def q_c1(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    dedup, before, removed = C.drop_duplicates(li.unionByName(li.where("l_returnflag = 'R'")))
    return dedup.agg(F.count("*").alias("rows_after")).select(
        F.lit(before).cast("long").alias("rows_before"), "rows_after", F.lit(removed).cast("long").alias("duplicates_removed"))


@register("p13_p14_quality_recommendations", _CLEAN_CTE + """,
m AS (SELECT (SELECT COUNT(*) FROM messy) AS original_rows, 9 AS original_cols,
             (SELECT COUNT(*) FROM messy) - (SELECT COUNT(*) FROM d) AS duplicates_removed,
             (SELECT COUNT(*) * 9 - COUNT("price_text (USD)") - COUNT("discount_text (%)") - COUNT(returned)
                     - COUNT(ship_text) - COUNT(status) - COUNT(qty) - COUNT(part_ref) - COUNT(l_orderkey)
                     - COUNT(l_linenumber) FROM t) AS total_missing),
s AS (SELECT round_even(100 - total_missing * 100.0 / (original_rows * original_cols), 1) AS completeness,
             round_even(duplicates_removed * 100.0 / original_rows, 1) AS duplicate_rate, 0.0 AS anomaly_rate,
             total_missing, duplicates_removed FROM m)
SELECT 'Missing data detected' AS title, CASE WHEN completeness < 80 THEN 'High' ELSE 'Medium' END AS severity,
       'Data Quality' AS category, completeness FROM s WHERE completeness < 95
UNION ALL
SELECT 'Duplicate rows found', CASE WHEN duplicate_rate > 10 THEN 'High' ELSE 'Medium' END, 'Data Quality', completeness
FROM s WHERE duplicate_rate > 0
UNION ALL
SELECT 'Data looks healthy', 'Low', 'Data Quality', completeness FROM s
WHERE NOT (completeness < 95 OR duplicate_rate > 0 OR anomaly_rate > 0)
""")
def q_p13(spark, sf_dir):
    _, report_df, _ = C.clean(messy_lineitem(spark, sf_dir))
    scores = P.quality_scores(report_df)
    c = scores.select("completeness").scalar()
    return P.recommendations(scores).select("title", "severity", "category", c.alias("completeness"))


# ---------------------------------------------------------------------------------------------
# A: anomalies, segments, outcome risk, chart samples
# ---------------------------------------------------------------------------------------------

from sheetwise.operators import anomaly as AN  # noqa: E402
from sheetwise.operators import ml as ML  # noqa: E402


@register("a1_anomaly_summary_lineitem")
def q_a1(spark, sf_dir):
    _, summary = AN.detect_anomalies(table(spark, sf_dir, "lineitem"))
    return summary


def planted_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with an impossible quantity on about one row in a hundred: the rows with the highest
    discount and the highest tax rate. The other quantities are fifty values, each very frequent."""
    odd = (F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08)
    return table(spark, sf_dir, "lineitem").withColumn(
        "l_quantity", F.when(odd, F.lit(5000.0)).otherwise(F.col("l_quantity").cast("double")))


@register("a1_planted_rows_are_flagged", """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_discount = 0.1 AND l_tax = 0.08
""")
def q_a1_planted(spark, sf_dir):
    """Every row with a planted quantity, and only those among the rows flagged with a quantity that
    no order has."""
    scored, _ = AN.detect_anomalies(planted_quantities(spark, sf_dir), cols=["l_quantity"])
    return AN.anomalous_rows(scored).where("l_quantity > 50").select("l_orderkey", "l_linenumber", "l_extendedprice")


@register("a1_no_false_alarms", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount = 0.1 AND l_tax = 0.08
""")
def q_a1_exactly(spark, sf_dir):
    """All other rows alike: the rows flagged are the planted ones and no others."""
    odd = (F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(odd, 5000.0).otherwise(10.0).alias("q"))
    scored, _ = AN.detect_anomalies(lines, cols=["q"])
    return AN.anomalous_rows(scored).select("l_orderkey", "l_linenumber")


@register("a2_strangest_rows_lineitem")
def q_a2(spark, sf_dir):
    scored, _ = AN.detect_anomalies(table(spark, sf_dir, "lineitem"))
    return AN.strangest_rows(scored, 20)


@register("a2_strangest_values_planted", "SELECT 5000.0 AS l_quantity, 20 AS rows")
def q_a2_planted(spark, sf_dir):
    """The twenty strangest of all rows of the planted table have the planted quantity."""
    scored, _ = AN.detect_anomalies(planted_quantities(spark, sf_dir), cols=["l_quantity"])
    return AN.strangest_rows(scored, 20).groupBy("l_quantity").agg(F.count("*").cast("int").alias("rows"))


@register("a2_anomalous_rows_orders")
def q_a2_rows(spark, sf_dir):
    scored, _ = AN.detect_anomalies(table(spark, sf_dir, "orders"))
    return AN.anomalous_rows(scored)


@register("a3_segments_part_brand")
def q_a3(spark, sf_dir):
    seg = ML.segment_categories(table(spark, sf_dir, "part"), "p_brand", ["p_retailprice", "p_size"], 3)
    return seg["profile"]


# Volumes of the flag/status combinations weighted so that they fall into three clearly separate sizes.
@register("a3_segments_flag_status_members", """
WITH g AS (SELECT l_returnflag || l_linestatus AS flag_status,
                  SUM(l_quantity * CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 20 ELSE 100 END) AS q
           FROM lineitem GROUP BY 1),
m AS (SELECT MAX(q) AS top FROM g)
SELECT flag_status, CAST(CASE WHEN q > 0.6 * top THEN 0 WHEN q > 0.1 * top THEN 1 ELSE 2 END AS INTEGER) AS segment
FROM g, m
""")
def q_a3_members(spark, sf_dir):
    weight = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 20).otherwise(100)
    li = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("flag_status"), (F.col("l_quantity") * weight).alias("volume"))
    return ML.segment_categories(li, "flag_status", ["volume"], 3)["segments"].select("flag_status", "segment")


def finished_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with a two-valued outcome (finished or not) and features that take few values."""
    return table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "finished").otherwise("open").alias("outcome"),
        F.year("o_orderdate").alias("year"), F.col("o_orderpriority").substr(1, 1).cast("int").alias("priority"),
        "o_totalprice")


@register("a4_outcome_risk_order_status")
def q_a4(spark, sf_dir):
    res = ML.binary_outcome_risk_model(finished_orders(spark, sf_dir), "outcome", ["year", "priority", "o_totalprice"])
    return res["feature_importances"]


_CLASSES = """
c AS (SELECT (CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'open' END) = 'open' AS positive, COUNT(*) AS n
      FROM orders GROUP BY 1)
"""


@register("a4_split_is_stratified", f"""
WITH {_CLASSES}
SELECT positive, true AS test, CAST(round_even(n * 0.25, 0) AS BIGINT) AS n FROM c
UNION ALL SELECT positive, false, n - CAST(round_even(n * 0.25, 0) AS BIGINT) FROM c
""")
def q_a4_split(spark, sf_dir):
    res = ML.binary_outcome_risk_model(finished_orders(spark, sf_dir), "outcome", ["priority"])
    return res["split"]


# One 0/1 feature that the outcome is derived from by known shares: without a penalty worth speaking of
# the two fitted probabilities are the shares themselves.
@register("a4_risk_scores_are_the_shares", """
WITH d AS (SELECT l_returnflag = 'N' AS late, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y FROM lineitem)
SELECT late, COUNT(*) AS n, true AS close FROM d GROUP BY late
""")
def q_a4_shares(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "N").cast("int").alias("late"),
        F.when(F.col("l_quantity") + 10 * (F.col("l_returnflag") == "N").cast("int") > 30, "yes").otherwise("no").alias("big"))
    scored = ML.binary_outcome_risk_model(d, "big", ["late"], C=1000.0)["scored"]
    share = F.avg((F.col("big") == "yes").cast("double"))
    return scored.groupBy((F.col("late") == 1).alias("late")).agg(
        F.count("*").alias("n"), (F.abs(share - F.avg("risk_score")) < 0.02).alias("close"))


@register("a5_chart_sample_lineitem")
def q_a5(spark, sf_dir):
    sample, _ = ML.sample_for_chart(table(spark, sf_dir, "lineitem"), 5000)
    return sample


@register("a5_chart_sample_covers_values", """
SELECT CAST(LEAST(COUNT(*), 5000) AS BIGINT) AS rows, COUNT(*) > 5000 AS sampled,
       COUNT(DISTINCT l_quantity) AS quantities, true AS shares_close
FROM lineitem
""")
def q_a5_values(spark, sf_dir):
    """A sample of 5000 rows shows every one of the fifty quantities, at about its share of all rows."""
    li = table(spark, sf_dir, "lineitem")
    sample, sampled = ML.sample_for_chart(li, 5000)
    sample = sample.checkpoint()

    def shares(df, name):
        total = df.agg(F.count("*")).first()[0]
        return df.groupBy("l_quantity").agg((F.count("*") / F.lit(total)).alias(name))

    both = shares(li, "a").join(shares(sample, "b"), "l_quantity", "left")
    return both.agg(F.lit(sample.count()).cast("long").alias("rows"), F.lit(sampled).alias("sampled"),
                    F.count("b").alias("quantities"), (F.max(F.abs(F.col("a") - F.col("b"))) < 0.012).alias("shares_close"))


@register("a6_chart_sample_keeps_anomalies")
def q_a6(spark, sf_dir):
    scored, _ = AN.detect_anomalies(table(spark, sf_dir, "lineitem"))
    sample, _ = ML.sample_for_chart_preserving_flag(scored, "_anomaly", 5000)
    return sample


@register("a6_chart_sample_keeps_every_flagged_row", """
WITH d AS (SELECT *, l_discount = 0.1 AND l_tax = 0.08 AS flagged FROM lineitem),
c AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (WHERE flagged) AS f FROM d)
SELECT CAST(LEAST(n, GREATEST(5000, f)) AS BIGINT) AS rows, f AS flagged,
       (SELECT COUNT(DISTINCT l_quantity) FROM d WHERE NOT flagged) AS quantities
FROM c
""")
def q_a6_flagged(spark, sf_dir):
    li = planted_quantities(spark, sf_dir).withColumn("flagged", F.col("l_quantity") == 5000.0)
    sample, _ = ML.sample_for_chart_preserving_flag(li, "flagged", 5000)
    return sample.agg(F.count("*").alias("rows"), F.count_if("flagged").alias("flagged"),
                      F.size(F.collect_set(F.when(~F.col("flagged"), F.col("l_quantity")))).cast("long").alias("quantities"))


# ---------------------------------------------------------------------------------------------
# S sources and sinks; J jobs; streaming usage report
# ---------------------------------------------------------------------------------------------

from sheetwise.plans import jobs as J  # noqa: E402
from sheetwise.sources import io as IO  # noqa: E402
from sheetwise.streaming import activity as ST  # noqa: E402

GIVEN_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
                "pages benchmark labels conversations").split()


@register("s1_csv_roundtrip_orders", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders
""")
def q_s1(spark, sf_dir):
    path = IO.scratch_dir(spark, "csv")
    IO.export_csv(table(spark, sf_dir, "orders"), path)
    return IO.read_table(spark, path, format="csv")


@register("s3_combine_orders_by_status", """
SELECT CASE WHEN o_orderstatus = 'F' THEN 'orders_finished' ELSE 'orders_open' END AS source_file,
       COUNT(*) AS rows
FROM orders GROUP BY 1
""")
def q_s3(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    finished = orders.where(F.col("o_orderstatus") == "F")
    other = orders.where(~F.col("o_orderstatus").eqNullSafe("F")).drop("o_orderpriority") \
        .withColumn("o_note", F.lit("open"))
    _, counts, _ = IO.combine([("orders_finished", finished), ("orders_open", other)])
    return counts


def _rank_sql() -> str:
    from sheetwise.plans.tables import GIVEN_SCHEMAS
    parts = []
    for t, cols in GIVEN_SCHEMAS.items():
        k = len(cols)
        nulls = " + ".join(f"(COUNT(*) - COUNT({c}))" for c in cols)
        parts.append(
            f"SELECT '{t}' AS name, CASE WHEN COUNT(*) * {k} > 0 THEN round_even(LEAST(COUNT(*), 1000) * {min(k, 20)} "
            f"* GREATEST(1 - ({nulls}) / (COUNT(*) * {k}.0), 0.1), 2) ELSE 0.0 END AS score FROM {t}")
    return "\nUNION ALL\n".join(parts)


@register("s4_rank_given_tables", _rank_sql())
def q_s4(spark, sf_dir):
    return IO.rank_tables({t: table(spark, sf_dir, t) for t in GIVEN_TABLES})


@register("s7_s9_saved_analysis_roundtrip_customer", "SELECT * FROM customer")
def q_s7(spark, sf_dir):
    root = IO.scratch_dir(spark, "saved")
    cust = table(spark, sf_dir, "customer")
    report = {"cleaned_rows": cust.count(), "original_cols": len(cust.columns)}
    aid = IO.save_analysis(spark, root, "user-1", "customers", cust, report)
    listed = IO.list_saved_analyses(spark, root, "user-1").collect()
    assert [r["analysis_id"] for r in listed] == [aid]
    data, _ = IO.load_analysis(spark, root, "user-1", aid)
    return data


@register("j1_analyze_orders_quality", """
WITH c AS (SELECT COUNT(*) AS n,
                  (COUNT(*) - COUNT(o_orderkey)) + (COUNT(*) - COUNT(o_custkey)) + (COUNT(*) - COUNT(o_orderstatus))
                  + (COUNT(*) - COUNT(o_totalprice)) + (COUNT(*) - COUNT(o_orderdate))
                  + (COUNT(*) - COUNT(o_orderpriority)) AS missing FROM orders),
d AS (SELECT COUNT(*) AS n_distinct FROM (SELECT DISTINCT * FROM orders))
SELECT round_even(100 - missing * 100.0 / (n * 6), 1) AS completeness,
       round_even((n - n_distinct) * 100.0 / n, 1) AS duplicate_rate,
       missing AS total_missing, n - n_distinct AS duplicates_removed
FROM c, d
""")
def q_j1(spark, sf_dir):
    q = J.analyze(table(spark, sf_dir, "orders"))["quality"]
    return q.select("completeness", "duplicate_rate", F.col("total_missing").cast("long"),
                    F.col("duplicates_removed").cast("long"))


@register("j2_autopilot_orders_forecast", ORACLE_SQL["t2_forecast_orders_daily_revenue"])
def q_j2(spark, sf_dir):
    analysis = J.analyze(table(spark, sf_dir, "orders"))
    res = J.autopilot(analysis, goal="how will totalprice develop")
    return _r(res["forecast"]["series"], 2, "o_totalprice", "lower", "upper")


@register("j2_recommendations_messy_lineitem",
          f"SELECT title, severity, category FROM ({ORACLE_SQL['p13_p14_quality_recommendations']}) AS r")
def q_j2_recs(spark, sf_dir):
    """Recommendations of the autopilot but the one on unusual rows, whose share is not SQL's to tell."""
    recs = J.autopilot(J.analyze(messy_lineitem(spark, sf_dir)))["recommendations"]
    return recs.where("category <> 'Anomaly'").select("title", "severity", "category")


@register("j2_metric_named_by_goal", "SELECT 'o_totalprice' AS metric, COUNT(*) > 0 AS found FROM orders")
def q_j2_metric(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    res = J.autopilot({"data": orders, "labels": P.column_labels(orders), "quality": P.quality_scores(C.clean(orders)[1])},
                      goal="how will totalprice develop")
    return res["forecast"]["series"].agg(F.lit(res["forecast_metric"]).alias("metric"), (F.count("*") > 0).alias("found"))


# One query for every analysis of every industry view. Category and metric are the suggested
# ones where none is named.

def _insight(spark, sf_dir, name: str, industry: str, analysis: str, **given):
    return J.industry_insights(table(spark, sf_dir, name), industry, include=(analysis,), **given)[analysis]


_LINE_KPIS = """
WITH g AS (SELECT l_returnflag, CAST(COALESCE(SUM(l_quantity), 0) AS DOUBLE) AS total
           FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag),
s AS (SELECT SUM(total) AS gs, COUNT(*) AS cc FROM g),
t AS (SELECT l_returnflag AS top_category, total AS top_total FROM g ORDER BY total DESC, l_returnflag LIMIT 1)
SELECT round_even(gs, 2) AS total, cc AS category_count, top_category,
       CASE WHEN gs <> 0 THEN round_even(top_total / gs * 100, 1) ELSE 0.0 END AS top_category_share_pct,
       round_even(gs / cc, 2) AS avg_per_category, 'sum' AS agg
FROM s, t
"""
_ORDERS = {"category": "o_orderpriority", "metric": "o_totalprice"}
_TOP_SQL = """
WITH g AS (SELECT o_orderpriority, CAST(COALESCE(SUM(o_totalprice), 0) AS DOUBLE) AS total
           FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT o_orderpriority, round_even(total, 2) AS total,
       round_even(total / (SELECT SUM(total) FROM g) * 100, 1) AS share_pct
FROM g ORDER BY total DESC, o_orderpriority LIMIT 10
"""


@register("j3_retail_kpis", _LINE_KPIS)
def q_j3_retail_kpis(spark, sf_dir):
    return _insight(spark, sf_dir, "lineitem", "sales_retail", "kpis")


@register("j3_retail_top_performers", _TOP_SQL)
def q_j3_retail_top(spark, sf_dir):
    return _r(_insight(spark, sf_dir, "orders", "sales_retail", "top_performers", **_ORDERS), 2, "total")


@register("j3_retail_trend", ORACLE_SQL["t1_orders_daily_revenue"])
def q_j3_retail_trend(spark, sf_dir):
    return _r(_insight(spark, sf_dir, "orders", "sales_retail", "trend", **_ORDERS), 2, "total")


@register("j3_retail_segments", """
SELECT COUNT(DISTINCT o_orderpriority) AS categories, 3 AS segments, SUM(o_totalprice) > 0 AS complete FROM orders
""")
def q_j3_retail_segments(spark, sf_dir):
    seg = _insight(spark, sf_dir, "orders", "sales_retail", "segments", **_ORDERS)
    return seg["segments"].agg(F.count("*").alias("categories"), F.count_distinct("segment").cast("int").alias("segments"),
                               (F.sum("o_totalprice") > 0).alias("complete"))


@register("j3_retail_forecast", ORACLE_SQL["t2_forecast_orders_daily_revenue"])
def q_j3_retail_forecast(spark, sf_dir):
    out = _insight(spark, sf_dir, "orders", "sales_retail", "forecast", **_ORDERS)["series"]
    return _r(out, 2, "o_totalprice", "lower", "upper")


@register("u3_daily_activity_streaming", """
SELECT CAST(ts AS DATE) AS day, COUNT(*) AS events, COUNT(DISTINCT user_id) AS sessions
FROM events GROUP BY 1
""")
def q_u3_stream(spark, sf_dir):
    out = IO.scratch_dir(spark, "activity")
    # the stream source watches a folder or a glob of files; here the glob names the one file
    return ST.daily_activity(spark, f"{sf_dir.rstrip('/')}/events*.parquet", out, ts="ts", session="user_id")


@register("s3_combine_files_orders_customer", """
SELECT 'orders.parquet' AS source_file, COUNT(*) AS rows FROM orders
UNION ALL SELECT 'customer.parquet', COUNT(*) FROM customer
""")
def q_s3_files(spark, sf_dir):
    base = sf_dir.rstrip("/")
    _, counts, _ = IO.combine_files(spark, [f"{base}/orders.parquet", f"{base}/customer.parquet"])
    return counts


# Whole texts: the cleaning and profiling operators over the prose tables (values up to tens of
# thousands of characters go through the number-text, yes/no and date checks unabridged).

@register("c12_clean_documents", "SELECT DISTINCT * FROM documents")
def q_c12_docs(spark, sf_dir):
    cleaned, _, _ = C.clean(table(spark, sf_dir, "documents"))
    return cleaned


@register("p6_category_profile_documents", """
WITH l AS (SELECT 'text' AS "column", text AS value FROM documents
           UNION ALL SELECT 'lang', lang FROM documents
           UNION ALL SELECT 'source', source FROM documents),
c AS (SELECT "column", value, COUNT(*) AS count FROM l WHERE value IS NOT NULL GROUP BY ALL)
SELECT "column", value, count, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM c)
WHERE rank <= 5
""")
def q_p6_docs(spark, sf_dir):
    return P.category_profile(table(spark, sf_dir, "documents"))


@register("p7_sample_values_pages", """
SELECT 'page_id' AS "column", CAST(rn AS INTEGER) AS rank, CAST(v AS VARCHAR) AS value FROM (
  SELECT v, row_number() OVER (ORDER BY v) AS rn FROM (SELECT DISTINCT page_id AS v FROM pages)) WHERE rn <= 3
UNION ALL
SELECT 'url', CAST(rn AS INTEGER), v FROM (
  SELECT v, row_number() OVER (ORDER BY v) AS rn FROM (SELECT DISTINCT url AS v FROM pages WHERE url IS NOT NULL)) WHERE rn <= 3
UNION ALL
SELECT 'html', CAST(rn AS INTEGER), v FROM (
  SELECT v, row_number() OVER (ORDER BY v) AS rn FROM (SELECT DISTINCT html AS v FROM pages WHERE html IS NOT NULL)) WHERE rn <= 3
""")
def q_p7_pages(spark, sf_dir):
    return P.sample_values(table(spark, sf_dir, "pages"), 3)


@register("s6_export_report_cleaned_orders", """
SELECT o_orderkey AS "O Orderkey", o_custkey AS "O Custkey", o_orderstatus AS "O Orderstatus",
       o_totalprice AS "O Totalprice", strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS "O Orderdate",
       o_orderpriority AS "O Orderpriority"
FROM orders
""")
def q_s6(spark, sf_dir):
    base = IO.scratch_dir(spark, "report")
    orders = table(spark, sf_dir, "orders")
    stats = P.compute_stats(orders)
    paths = IO.export_report(base, orders, stats=stats)
    return IO.read_table(spark, paths[0], format="csv")


_PRICES = {"category": "l_returnflag", "metric": "l_extendedprice",
           "sequence_cols": ["l_orderkey", "l_linenumber", "l_extendedprice"]}


@register("j3_engineering_histogram", """
WITH d AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem WHERE l_extendedprice IS NOT NULL AND NOT isnan(l_extendedprice)),
b AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM d),
w AS (SELECT lo, hi, CASE WHEN hi > lo THEN (hi - lo) / 30 ELSE 1.0 END AS w FROM b),
c AS (SELECT LEAST(CAST(floor((x - lo) / w) AS INTEGER), 29) AS bin, COUNT(*) AS n FROM d, w GROUP BY 1)
SELECT s.bin AS bin, round_even(lo + s.bin * w, 4) AS lo, round_even(lo + (s.bin + 1) * w, 4) AS hi,
       COALESCE(c.n, 0) AS count
FROM w, range(0, 30) AS s(bin) LEFT JOIN c ON c.bin = s.bin
""")
def q_j3_eng_histogram(spark, sf_dir):
    out = _insight(spark, sf_dir, "lineitem", "engineering_manufacturing", "histogram", **_PRICES)
    return _r(out.withColumn("bin", F.col("bin").cast("long")), 4, "lo", "hi")


@register("j3_engineering_control_chart", ORACLE_SQL["t5_control_chart_summary"])
def q_j3_eng_chart(spark, sf_dir):
    return _insight(spark, sf_dir, "lineitem", "engineering_manufacturing", "control_chart", **_PRICES)["summary"]


@register("j3_engineering_time_to_limit", ORACLE_SQL["t6_time_to_limit_extendedprice"])
def q_j3_eng_limit(spark, sf_dir):
    return _insight(spark, sf_dir, "lineitem", "engineering_manufacturing", "time_to_limit", **_PRICES)


_BALANCES = {"category": "c_mktsegment", "metric": "c_acctbal"}


@register("j3_finance_concentration", """
WITH g AS (SELECT c_mktsegment, CAST(COALESCE(SUM(c_acctbal), 0) AS DOUBLE) AS total
           FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment),
s AS (SELECT SUM(total) AS grand FROM g),
h AS (SELECT SUM((total / grand) * (total / grand)) AS hhi FROM g, s),
t AS (SELECT c_mktsegment AS top_category, total AS top_total FROM g ORDER BY total DESC, c_mktsegment LIMIT 1)
SELECT round_even(hhi, 4) AS hhi,
       CASE WHEN hhi < 0.15 THEN 'Low' WHEN hhi < 0.25 THEN 'Moderate' ELSE 'High' END AS risk_level,
       top_category,
       CASE WHEN grand <> 0 THEN round_even(top_total / grand * 100, 1) ELSE 0.0 END AS top_category_share_pct
FROM h, t, s
""")
def q_j3_fin(spark, sf_dir):
    return _insight(spark, sf_dir, "customer", "finance_banking", "concentration", **_BALANCES)["summary"]


@register("j3_finance_kpis", ORACLE_SQL["g3_kpi_customer_segment_balance"])
def q_j3_fin_kpis(spark, sf_dir):
    return _insight(spark, sf_dir, "customer", "finance_banking", "kpis", **_BALANCES)


@register("j3_finance_trend", ORACLE_SQL["t1_orders_daily_revenue"])
def q_j3_fin_trend(spark, sf_dir):
    return _r(_insight(spark, sf_dir, "orders", "finance_banking", "trend", **_ORDERS), 2, "total")


@register("j3_finance_strangest_rows", "SELECT CAST(20 AS BIGINT) AS rows, CAST(20 AS BIGINT) AS planted")
def q_j3_fin_strange(spark, sf_dir):
    """The table was not scored before: the view scores it, on all its numeric columns."""
    odd = planted_quantities(spark, sf_dir).select("l_orderkey", "l_returnflag", "l_quantity")
    rows = J.industry_insights(odd, "finance_banking", "l_returnflag", "l_quantity", include=("strangest_rows",))
    return rows["strangest_rows"].agg(F.count("*").alias("rows"), F.count_if(F.col("l_quantity") == 5000.0).alias("planted"))


@register("j3_healthcare_kpis", _LINE_KPIS)
def q_j3_health_kpis(spark, sf_dir):
    return _insight(spark, sf_dir, "lineitem", "healthcare", "kpis")


@register("j3_healthcare_ranking", _TOP_SQL)
def q_j3_health_top(spark, sf_dir):
    return _r(_insight(spark, sf_dir, "orders", "healthcare", "top_performers", **_ORDERS), 2, "total")


@register("j3_healthcare_trend", ORACLE_SQL["t1_orders_daily_revenue"])
def q_j3_health_trend(spark, sf_dir):
    return _r(_insight(spark, sf_dir, "orders", "healthcare", "trend", **_ORDERS), 2, "total")


@register("j3_healthcare_control_chart", ORACLE_SQL["t5_control_chart_summary"])
def q_j3_health_chart(spark, sf_dir):
    return _insight(spark, sf_dir, "lineitem", "healthcare", "control_chart", **_PRICES)["summary"]


@register("j3_healthcare_forecast", ORACLE_SQL["t2_forecast_orders_daily_revenue"])
def q_j3_health_forecast(spark, sf_dir):
    out = _insight(spark, sf_dir, "orders", "healthcare", "forecast", **_ORDERS)["series"]
    return _r(out, 2, "o_totalprice", "lower", "upper")


@register("j3_healthcare_outcome_risk", """
SELECT l_linestatus AS outcome, COUNT(*) AS n, true AS in_range FROM lineitem GROUP BY 1
""")
def q_j3_health_risk(spark, sf_dir):
    """The outcome is the two-valued column that the roles find; every complete row is scored."""
    scored = _insight(spark, sf_dir, "lineitem", "healthcare", "outcome_risk")["scored"]
    return scored.groupBy(F.col("l_linestatus").alias("outcome")).agg(
        F.count("*").alias("n"), F.bool_and(F.col("risk_score").between(0, 1)).alias("in_range"))


# ---------------------------------------------------------------------------------------------
# Missing values: NaN in the metric counts as NULL in every operator
# ---------------------------------------------------------------------------------------------

def holey_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with NaN for the quantity of every returned row of one tax rate."""
    hole = (F.col("l_returnflag") == "R") & (F.col("l_tax") == 0.02)
    return table(spark, sf_dir, "lineitem").withColumn(
        "l_quantity", F.when(hole, F.lit(float("nan"))).otherwise(F.col("l_quantity").cast("double")))


_HOLEY = """h AS (SELECT * REPLACE (CASE WHEN l_returnflag = 'R' AND l_tax = 0.02 THEN NULL
                  ELSE CAST(l_quantity AS DOUBLE) END AS l_quantity) FROM lineitem)"""


@register("g1_ranking_with_nan", f"""
WITH {_HOLEY}, g AS (SELECT l_linestatus, COALESCE(SUM(l_quantity), 0) AS total FROM h GROUP BY 1)
SELECT l_linestatus, total, round_even(total / (SELECT SUM(total) FROM g) * 100, 1) AS share_pct FROM g
""")
def q_g1_nan(spark, sf_dir):
    return G.top_performers(holey_lineitem(spark, sf_dir), "l_linestatus", "l_quantity")


@register("g3_kpis_with_nan", f"""
WITH {_HOLEY}, g AS (SELECT l_linestatus, COALESCE(SUM(l_quantity), 0) AS total FROM h GROUP BY 1),
s AS (SELECT SUM(total) AS gs, COUNT(*) AS cc FROM g), t AS (SELECT * FROM g ORDER BY total DESC, l_linestatus LIMIT 1)
SELECT round_even(gs, 2) AS total, cc AS category_count, l_linestatus AS top_category,
       round_even(t.total / gs * 100, 1) AS top_category_share_pct, round_even(gs / cc, 2) AS avg_per_category, 'sum' AS agg
FROM s, t
""")
def q_g3_nan(spark, sf_dir):
    return G.kpi_summary(holey_lineitem(spark, sf_dir), "l_linestatus", "l_quantity")


@register("g4_chart_median_with_nan", f"""
WITH {_HOLEY} SELECT l_returnflag, median(l_quantity) AS l_quantity FROM h GROUP BY 1
""")
def q_g4_nan(spark, sf_dir):
    return G.chart_aggregate(holey_lineitem(spark, sf_dir), "l_returnflag", "l_quantity", agg="median")


@register("t1_trend_with_nan", f"""
WITH {_HOLEY}, g AS (SELECT last_day(CAST(l_shipdate AS DATE)) AS period, SUM(l_quantity) AS total FROM h
                     WHERE l_quantity IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY 1),
  c AS (SELECT last_day(CAST(unnest(generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH)) AS DATE)) AS period
        FROM (SELECT MIN(period) AS lo, MAX(period) AS hi FROM g))
SELECT CAST(period AS TIMESTAMP) AS period, COALESCE(total, 0) AS total FROM c LEFT JOIN g USING (period)
""")
def q_t1_nan(spark, sf_dir):
    return TS.time_trend(holey_lineitem(spark, sf_dir), "l_shipdate", "l_quantity", "M")


@register("p1_stats_with_nan", f"""
WITH {_HOLEY} SELECT 'l_quantity' AS "column", CAST(COUNT(l_quantity) AS DOUBLE) AS count, round_even(AVG(l_quantity), 3) AS mean,
  round_even(stddev_samp(l_quantity), 3) AS std, MIN(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS p25,
  median(l_quantity) AS p50, quantile_cont(l_quantity, 0.75) AS p75, MAX(l_quantity) AS max FROM h
""")
def q_p1_nan(spark, sf_dir):
    return P.compute_stats(holey_lineitem(spark, sf_dir).select("l_quantity"))


@register("p6_profile_with_nan", f"""
WITH {_HOLEY} SELECT 'l_quantity' AS "column", round_even(AVG(l_quantity), 2) AS mean, MIN(l_quantity) AS min,
  MAX(l_quantity) AS max, round_even(stddev_samp(l_quantity), 2) AS std, SUM(l_quantity) AS sum, COUNT(l_quantity) AS count FROM h
""")
def q_p6_nan(spark, sf_dir):
    return P.numeric_profile(holey_lineitem(spark, sf_dir).select("l_quantity"))


@register("t6_time_to_limit_with_nan", f"""
WITH {_HOLEY}, p AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS t
                     FROM h WHERE l_quantity IS NOT NULL),
f AS (SELECT regr_slope(v, t) AS b, arg_max(v, t) AS cur FROM p)
SELECT CASE WHEN abs(b) < 1e-9 THEN 0.0 ELSE round_even(b, 6) END AS slope, round_even(cur, 4) AS current_value FROM f
""")
def q_t6_nan(spark, sf_dir):
    return TS.time_to_limit(holey_lineitem(spark, sf_dir), "l_quantity", ["l_orderkey", "l_linenumber", "l_quantity"],
                            100.0, 0.0).select("slope", "current_value")


@register("u1_events_by_industry", """
SELECT CASE event_type WHEN 'purchase' THEN 'sales_retail' WHEN 'view' THEN 'finance_banking' WHEN 'signup' THEN 'healthcare' END AS industry,
       COUNT(*) AS events
FROM events GROUP BY 1 HAVING industry IS NOT NULL
""")
def q_u1_industry(spark, sf_dir):
    kind = F.col("event_type")
    industry = (F.when(kind == "purchase", "sales_retail").when(kind == "view", "finance_banking")
                .when(kind == "signup", "healthcare"))
    return U.events_by(table(spark, sf_dir, "events").withColumn("industry", industry), "industry", drop_null=True)


# ---------------------------------------------------------------------------------------------
# Dates as text in many forms, CSV files that differ in header and encoding
# ---------------------------------------------------------------------------------------------

def orders_with_text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with the day written in another form for every priority."""
    def form(pattern):
        return F.date_format("o_orderdate", pattern)

    p = F.col("o_orderpriority").substr(1, 1)
    text = (F.when(p == "1", form("dd-MMM-yyyy"))
            .when(p == "2", F.concat(form("yyyy-MM-dd"), F.lit("T01:30:00+01:30")))
            .when(p == "3", F.concat(form("M/d/yyyy"), F.lit(" 11:15 PM")))
            .when(p == "4", F.concat(form("yyyy-MM-dd"), F.lit(" 10:00:00.123456789")))
            .otherwise(form("MMMM d, yyyy")))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", text.alias("day"))


@register("t1_daily_from_text_dates", ORACLE_SQL["t1_orders_daily_revenue"])
def q_t1_text(spark, sf_dir):
    return _r(TS.time_trend(orders_with_text_dates(spark, sf_dir), "day", "o_totalprice", "D"), 2, "total")


@register("c7_text_dates_read", """
SELECT o_orderpriority, COUNT(*) AS rows, COUNT(*) AS read, MIN(CAST(o_orderdate AS DATE)) AS first_day,
       MAX(CAST(o_orderdate AS DATE)) AS last_day
FROM orders GROUP BY 1
""")
def q_c7_forms(spark, sf_dir):
    read = F.to_date(parse_timestamp(F.col("day")))
    return orders_with_text_dates(spark, sf_dir).groupBy("o_orderpriority").agg(
        F.count("*").alias("rows"), F.count(read).alias("read"), F.min(read).alias("first_day"), F.max(read).alias("last_day"))


@register("t1_unread_dates_are_counted", """
SELECT COUNT(*) AS rows, COUNT(*) FILTER (WHERE o_orderpriority LIKE '5%') AS unread FROM orders
""")
def q_t1_unread(spark, sf_dir):
    odd = orders_with_text_dates(spark, sf_dir).withColumn(
        "day", F.when(F.col("o_orderpriority").startswith("5"), "some day soon").otherwise(F.col("day")))
    return TS.unread_dates(odd, "day")


def orders_with_odd_dates(spark, sf_dir):
    """Order days as text in one other form for each priority, none of them a listed pattern."""
    day, p = F.to_date("o_orderdate"), F.substring("o_orderpriority", 1, 1)

    def form(f):
        return F.date_format(day, f)

    text = (F.when(p == "1", F.concat(form("EEEE, d"), F.lit("th of "), form("MMMM yyyy")))
            .when(p == "2", form("yyyy.MM.dd HH:mm"))
            .when(p == "3", form("yyyy年M月d日"))
            .when(p == "4", form("d.M.yy HH:mm:ss"))
            .otherwise(F.concat(form("EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", text.alias("day"))


@register("c7_dates_read_by_shape", """
SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, COUNT(*) AS rows
FROM orders GROUP BY 1, 2
""")
def q_c7_shapes(spark, sf_dir):
    read = DS.read_dates(orders_with_odd_dates(spark, sf_dir), "day")
    return read.groupBy("o_orderpriority", F.to_date("day").alias("day")).agg(F.count("*").alias("rows"))


@register("c7_unread_shapes", """
SELECT CASE WHEN o_orderpriority LIKE '1%' THEN '999.999.9.9' WHEN o_orderpriority LIKE '2%' THEN NULL END AS shape, COUNT(*) AS n
FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' GROUP BY 1
""")
def q_c7_unread(spark, sf_dir):
    p = F.substring("o_orderpriority", 1, 1)
    odd = orders_with_odd_dates(spark, sf_dir).withColumn(
        "day", F.when(p == "1", F.lit("192.168.0.1")).when(p == "2", F.concat(F.lit("in the week of "), F.col("day")))
        .otherwise(F.col("day")))
    return DS.unread_shapes(odd, "day")


@register("t1_daily_from_odd_dates", ORACLE_SQL["t1_orders_daily_revenue"])
def q_t1_odd(spark, sf_dir):
    return _r(TS.time_trend(orders_with_odd_dates(spark, sf_dir), "day", "o_totalprice", "D"), 2, "total")


@register("c12_clean_finds_odd_date_columns", """
SELECT MIN(CAST(o_orderdate AS DATE)) AS first_day, MAX(CAST(o_orderdate AS DATE)) AS last_day, COUNT(*) AS rows,
       COUNT(*) AS read FROM orders
""")
def q_c12_odd(spark, sf_dir):
    cleaned, _, _ = C.clean(orders_with_odd_dates(spark, sf_dir))
    return cleaned.agg(F.to_date(F.min("day")).alias("first_day"), F.to_date(F.max("day")).alias("last_day"),
                       F.count("*").alias("rows"), F.count("day").alias("read"))


@register("s1_csv_mixed_headers", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
       CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority FROM orders
""")
def q_s1_headers(spark, sf_dir):
    """Two folders of CSV files with columns in another order, one column missing in some."""
    orders, base = table(spark, sf_dir, "orders"), IO.scratch_dir(spark, "csv-headers")
    done = orders.where("o_orderstatus = 'F'").select("o_totalprice", "o_orderstatus", "o_orderdate", "o_custkey", "o_orderkey")
    IO.export_csv(done, f"{base}/done")
    IO.export_csv(orders.where("o_orderstatus <> 'F'"), f"{base}/other")
    return IO.read_csv(spark, [f"{base}/done", f"{base}/other"])


@register("s1_csv_mixed_encodings", r"""
SELECT doc_id, nullif(text, '') AS "text é" FROM documents
""")
def q_s1_encodings(spark, sf_dir):
    """Whole documents, with their line breaks and quotes, under a header with a letter beyond ASCII:
    the French and Spanish ones in latin-1, the others in UTF-8."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text é"), "lang")
    base = IO.scratch_dir(spark, "csv-encodings")
    narrow = F.coalesce(F.col("lang").isin("fr", "es") & ~F.col("text é").rlike("[^\x00-\xff]"), F.lit(False))
    for folder, encoding, rows in (("narrow", "ISO-8859-1", docs.where(narrow)), ("wide", "UTF-8", docs.where(~narrow))):
        (rows.drop("lang").write.option("header", True).option("encoding", encoding).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/{folder}"))
    return IO.read_csv(spark, [f"{base}/narrow", f"{base}/wide"])


@register("s1_csv_quoted_line_breaks", "SELECT page_id, nullif(url, '') AS url, nullif(html, '') AS html FROM pages")
def q_s1_breaks(spark, sf_dir):
    """Raw web pages, full of quotes, commas and line breaks, exported and read back."""
    base = IO.scratch_dir(spark, "csv-pages")
    IO.export_csv(table(spark, sf_dir, "pages").select("page_id", "url", "html"), base)
    return IO.read_csv(spark, base)


@register("s9_deleted_analysis_is_gone", "SELECT * FROM customer")
def q_s9_delete(spark, sf_dir):
    root, cust = IO.scratch_dir(spark, "deleted"), table(spark, sf_dir, "customer")
    report = {"cleaned_rows": cust.count(), "original_cols": len(cust.columns)}
    gone, kept = (IO.save_analysis(spark, root, "user-1", name, cust, report) for name in ("first", "second"))
    assert IO.delete_analysis(spark, root, "user-1", gone) and not IO.delete_analysis(spark, root, "user-1", gone)
    assert [r["analysis_id"] for r in IO.list_saved_analyses(spark, root, "user-1").collect()] == [kept]
    return IO.load_analysis(spark, root, "user-1", kept)[0]


@register("s9_odd_user_names_keep_their_analyses", """
SELECT c_custkey, c_name, c_mktsegment, CASE c_mktsegment WHEN 'BUILDING' THEN 'a/b' WHEN 'MACHINERY' THEN 'a:b'
       WHEN 'FURNITURE' THEN 'a%b' ELSE '../x = y' END AS saved_for
FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'
""")
def q_s9_odd_users(spark, sf_dir):
    """Users whose names are no file names: each saves two tables, deletes the first and, after the log was
    compacted, loads the second."""
    root = IO.scratch_dir(spark, "odd-users")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    users = {"a/b": ("BUILDING",), "a:b": ("MACHINERY",), "a%b": ("FURNITURE",), "../x = y": ("HOUSEHOLD",)}
    kept = {}
    for user, segments in users.items():
        mine = cust.where(F.col("c_mktsegment").isin(*segments))
        first = IO.save_analysis(spark, root, user, "wrong", cust, {"cleaned_rows": 1})
        kept[user] = IO.save_analysis(spark, root, user, "right", mine, {"cleaned_rows": mine.count()})
        assert IO.delete_analysis(spark, root, user, first)
    assert IO.compact_analyses(spark, root) == len(users)
    out = None
    for user, analysis in kept.items():
        assert [r["analysis_id"] for r in IO.list_saved_analyses(spark, root, user).collect()] == [analysis]
        part = IO.load_analysis(spark, root, user, analysis)[0].withColumn("saved_for", F.lit(user))
        out = part if out is None else out.unionByName(part)
    return out


@register("u3_closed_days_streaming", """
SELECT CAST(ts AS DATE) AS day, COUNT(*) AS events, COUNT(DISTINCT user_id) AS sessions
FROM events WHERE CAST(ts AS DATE) + INTERVAL 2 DAY <= (SELECT MAX(ts) FROM events) GROUP BY 1
""")
def q_u3_closed(spark, sf_dir):
    """The bounded-state stream: a day is reported once, when it ended a day before the newest event."""
    out = IO.scratch_dir(spark, "closed-days")
    query = ST.run_daily_activity_bounded(spark, f"{sf_dir.rstrip('/')}/events*.parquet", out, ts="ts", session="user_id")
    query.awaitTermination()
    return spark.read.parquet(out)
