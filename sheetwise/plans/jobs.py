"""Composite jobs: J1 ``analyze``, J2 ``autopilot``, J3 ``industry_insights``.

Each returns named, lazily defined DataFrames built from the operators; the only actions are the
ones the operators need for their decisions (profile passes, fitted models, a forest).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.functions import naming as N
from sheetwise.operators import aggregate as G
from sheetwise.operators import anomaly as AN
from sheetwise.operators import clean as C
from sheetwise.operators import industry as IND
from sheetwise.operators import ml as ML
from sheetwise.operators import profile as P
from sheetwise.operators import timeseries as TS
from sheetwise.operators.topk import row_hash


def analyze(df: DataFrame, accuracy="auto") -> dict:
    """Clean (C12) -> anomalies (A1) -> quality scores (P13) -> industry (P12) -> labels."""
    cleaned, report_df, report = C.clean(df, accuracy=accuracy)
    scored, anomaly_summary = AN.detect_anomalies(cleaned, accuracy=accuracy)
    scores = P.quality_scores(report_df, anomaly_summary)
    catalog = IND.catalog_of({"table": cleaned})
    industry = IND.classify_tables(catalog)
    return {"data": scored, "report": report_df, "report_dict": report, "anomaly_summary": anomaly_summary,
            "quality": scores, "industry": industry, "labels": P.column_labels(cleaned)}


def autopilot(analysis: dict, goal: str | None = None, periods: int = 30) -> dict:
    """Recommendations (P14) and, when the table has a timestamp column and a numeric one,
    a forecast (T2) of the metric the goal text names (T4)."""
    data = analysis["data"]
    recs = P.recommendations(analysis["quality"])
    date_col = N.default_date_column(data)
    nums = N.numeric_columns(data)
    fc = None
    metric = None
    if date_col and nums:
        metric = N.pick_forecast_metric(nums, analysis.get("labels"), goal)
        fc = TS.forecast(data, date_col, metric, periods)
    return {"recommendations": recs, "forecast_metric": metric, "forecast": fc}


ANALYSES = ("kpis", "top_performers", "concentration", "trend", "segments", "forecast",
            "strangest_rows", "control_chart", "histogram", "time_to_limit", "outcome_risk")


def industry_insights(df: DataFrame, industry: str, category: str | None = None,
                      metric: str | None = None, date_col: str | None = None,
                      sequence_cols: list[str] | None = None, outcome: str | None = None,
                      include: tuple[str, ...] = ANALYSES) -> dict:
    """The fixed set of analyses of one industry view.

    retail: KPIs, top performers, trend, segments, forecast; finance: KPIs, concentration,
    trend, strangest rows; engineering: control chart, histogram, time to limit; healthcare:
    KPIs, ranking, trend, control chart, forecast, outcome risk. Category and metric default to
    the P8 suggestion, the date to P10. ``include`` limits the work to the named analyses (the
    model-fitting ones run eagerly)."""
    want = set(include)
    if industry not in IND.INDUSTRY_OPTIONS:
        raise ValueError(f"industry must be one of {list(IND.INDUSTRY_OPTIONS)}")
    roles = None
    if category is None or metric is None or ("outcome_risk" in want and industry == "healthcare" and not outcome):
        roles = P.suggest_roles(df)  # one cardinality pass serves the category, metric and outcome
    if category is None or metric is None:
        category = category or roles["category"]
        metric = metric or roles["metric"]
    date_col = date_col or N.default_date_column(df)
    out: dict = {"category": category, "metric": metric, "date_col": date_col}
    if "kpis" in want and industry in ("sales_retail", "finance_banking", "healthcare") and category and metric:
        out["kpis"] = G.kpi_summary(df, category, metric)
    if "top_performers" in want and industry in ("sales_retail", "healthcare") and category and metric:
        out["top_performers"] = G.top_performers(df, category, metric)
    if "concentration" in want and industry == "finance_banking" and category and metric:
        out["concentration"] = G.concentration_risk(df, category, metric)
    if "trend" in want and industry in ("sales_retail", "finance_banking", "healthcare") and date_col and metric:
        out["trend"] = TS.time_trend(df, date_col, metric, "D")
    if "segments" in want and industry == "sales_retail" and category and metric:
        nums = [c for c in N.numeric_columns(df) if c != category]
        try:
            out["segments"] = ML.segment_categories(df, category, nums or [metric])
        except ValueError as e:
            out["segments_error"] = str(e)
    if "forecast" in want and industry in ("sales_retail", "healthcare") and date_col and metric:
        out["forecast"] = TS.forecast(df, date_col, metric, 30)
    if "strangest_rows" in want and industry == "finance_banking":
        # tables that were not scored yet are scored here (no numeric column: no such analysis)
        scored = df if "_anomaly_score" in df.columns else AN.detect_anomalies(df)[0]
        if "_anomaly_score" in scored.columns:
            out["strangest_rows"] = AN.strangest_rows(scored, 20)
    if want & {"control_chart", "histogram", "time_to_limit"} and \
            industry in ("engineering_manufacturing", "healthcare") and metric:
        seq = sequence_cols or ([date_col] if date_col else None)
        cc = TS.control_chart(df, metric, seq[0] if seq else None)
        out["control_chart"] = cc
        if industry == "engineering_manufacturing":
            out["histogram"] = P.histogram(df, metric, 30)
            if seq and "time_to_limit" in want:
                lims = cc["limits"]
                try:
                    out["time_to_limit"] = TS.time_to_limit(df, metric, seq, lims.select("ucl").scalar(),
                                                            lims.select("lcl").scalar())
                except ValueError as e:
                    out["time_to_limit_error"] = str(e)
    if "outcome_risk" in want and industry == "healthcare":
        target = outcome or (roles["binary"][0] if roles and roles["binary"] else None)
        feats = [c for c in N.numeric_columns(df) if c != target]
        if target and feats:
            try:
                out["outcome_risk"] = ML.binary_outcome_risk_model(df, target, feats)
            except ValueError as e:
                out["outcome_risk_error"] = str(e)
    return out


def with_sequence(df: DataFrame, name: str = "_seq") -> DataFrame:
    """A repeatable sequence column for tables without one (hash of the row): use it only when
    the order of rows carries no meaning."""
    return df.withColumn(name, row_hash(df, 42))
