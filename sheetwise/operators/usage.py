"""Reports over an activity log (events) and a model-call log (api_calls).

Column names are parameters so that any log with the same meaning can be used; the defaults
follow the log schema ``events(id, ts, session_id, event_type, detail, industry)`` and
``api_calls(id, ts, session_id, kind, model, input_tokens, output_tokens)``.
Every report is a grouped aggregate (partial + final); distinct counts are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default price in USD per million tokens, as in the reference's estimate.
DEFAULT_PRICE_INPUT_PER_M = 3.0
DEFAULT_PRICE_OUTPUT_PER_M = 15.0


def events_by(events: DataFrame, key: str = "event_type", drop_null: bool = False) -> DataFrame:
    """``[key, events]`` event counts per value of ``key``; ``drop_null`` leaves out NULL
    keys (the industry breakdown does, the event-type one does not)."""
    src = events.select(key)
    if drop_null:
        src = src.where(F.col(key).isNotNull())
    return src.groupBy(key).agg(F.count("*").alias("events"))


def usage_totals(events: DataFrame, session: str = "session_id", event_type: str = "event_type",
                 error_value: str = "error") -> DataFrame:
    """One row ``sessions`` (distinct), ``errors`` (events of the error type), ``events``."""
    return events.agg(F.count_distinct(session).alias("sessions"),
                      F.count_if(F.col(event_type) == error_value).alias("errors"),
                      F.count("*").alias("events"))


def activity_over_time(events: DataFrame, ts: str = "ts", session: str = "session_id") -> DataFrame:
    """``[day, events, sessions]`` per calendar day, ordered by day."""
    return (events.select(F.to_date(ts).alias("day"), session)
                  .groupBy("day")
                  .agg(F.count("*").alias("events"), F.count_distinct(session).alias("sessions"))
                  .orderBy("day"))


def api_cost_estimate(calls: DataFrame, model: str = "model", input_tokens: str = "input_tokens",
                      output_tokens: str = "output_tokens", prices: dict | None = None) -> dict[str, DataFrame]:
    """U4: per model ``model, calls, input_tokens, output_tokens, est_cost_usd`` (NULL tokens
    count as 0, a NULL model is reported as 'unknown', cost rounded to 4) and the one-row
    ``total_est_cost_usd``. ``prices`` maps a model name to ``(input, output)`` USD per million;
    models absent from it use the default price. The map is a literal, not a join."""
    in_tok = F.coalesce(F.sum(input_tokens), F.lit(0)).cast("long")
    out_tok = F.coalesce(F.sum(output_tokens), F.lit(0)).cast("long")
    per_model = (calls.select(model, input_tokens, output_tokens)
                      .groupBy(model)
                      .agg(F.count("*").alias("calls"), in_tok.alias("input_tokens"),
                           out_tok.alias("output_tokens")))
    p_in, p_out = F.lit(DEFAULT_PRICE_INPUT_PER_M), F.lit(DEFAULT_PRICE_OUTPUT_PER_M)
    if prices:
        kv_in, kv_out = [], []
        for name, (pi, po) in prices.items():
            kv_in += [F.lit(name), F.lit(float(pi))]
            kv_out += [F.lit(name), F.lit(float(po))]
        p_in = F.coalesce(F.element_at(F.create_map(*kv_in), F.col(model)), p_in)
        p_out = F.coalesce(F.element_at(F.create_map(*kv_out), F.col(model)), p_out)
    cost = (F.col("input_tokens") / 1_000_000 * p_in + F.col("output_tokens") / 1_000_000 * p_out)
    priced = per_model.withColumn("_cost", cost)
    breakdown = priced.select(F.coalesce(F.col(model), F.lit("unknown")).alias("model"), "calls",
                              "input_tokens", "output_tokens",
                              F.bround("_cost", 4).alias("est_cost_usd"))
    total = priced.agg(F.bround(F.coalesce(F.sum("_cost"), F.lit(0.0)), 4).alias("total_est_cost_usd"))
    return {"breakdown": breakdown, "total": total}


def recent_events(events: DataFrame, n: int = 100, order_by: str = "id",
                  columns: list[str] | None = None) -> DataFrame:
    """The newest ``n`` events by id (a top-k: each task keeps ``n`` rows)."""
    cols = columns or [c for c in events.columns if c != order_by]
    return events.orderBy(F.col(order_by).desc()).limit(n).select(*cols)
