"""Reading the given tables, and the derived inputs some operators need (built by Spark from
those tables, so that their size grows with the data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def api_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model-call log derived from ``conversations``: one call per turn, the role as the model,
    text length as input tokens of user/system turns and output tokens of assistant turns."""
    conv = table(spark, sf_dir, "conversations")
    n = F.length("text").cast("long")
    is_out = F.col("role") == "assistant"
    return conv.select(
        F.col("conv_id").alias("session_id"),
        F.col("role").alias("model"),
        F.when(~is_out, n).alias("input_tokens"),
        F.when(is_out, n).alias("output_tokens"))


def messy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` rewritten the way spreadsheet exports look: prices as '$1,234.56' text,
    discounts as '5%', return flags as 'Yes'/'no', ship dates as 'dd/MM/yyyy' text, a text
    part reference, and values left empty on value-based conditions. Same derivation as
    :data:`MESSY_LINEITEM_SQL`."""
    li = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    dollars = F.floor(cents / 100).cast("long")
    c2 = (cents - dollars * 100).cast("long")
    thousands = F.floor(dollars / 1000).cast("long")
    rem = (dollars - thousands * 1000).cast("long")
    money = F.concat(F.lit("$"),
                     F.when(thousands > 0, F.concat(thousands.cast("string"), F.lit(","),
                                                    F.lpad(rem.cast("string"), 3, "0")))
                      .otherwise(rem.cast("string")),
                     F.lit("."), F.lpad(c2.cast("string"), 2, "0"))
    pct = F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))
    flag = F.when(F.col("l_returnflag") == "R", "Yes").when(F.col("l_returnflag") == "A", "no")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_tax") != 0.08, money).alias("price_text"),
        F.when(F.col("l_quantity") <= 45, pct).alias("discount_text"),
        flag.alias("returned"),
        F.when(F.col("l_discount") != 0.0, F.date_format("l_shipdate", "dd/MM/yyyy")).alias("ship_text"),
        F.when(F.col("l_tax") != 0.0, F.col("l_linestatus")).alias("status"),
        F.when(F.col("l_discount") != 0.1, F.col("l_quantity")).alias("qty"),
        F.col("l_partkey").cast("string").alias("part_ref"))


MESSY_LINEITEM_SQL = """
messy AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_tax <> 0.08 THEN
      '$' || CASE WHEN (CAST(round(l_extendedprice * 100) AS BIGINT) // 100) // 1000 > 0
                  THEN CAST((CAST(round(l_extendedprice * 100) AS BIGINT) // 100) // 1000 AS VARCHAR) || ',' ||
                       lpad(CAST((CAST(round(l_extendedprice * 100) AS BIGINT) // 100) % 1000 AS VARCHAR), 3, '0')
                  ELSE CAST((CAST(round(l_extendedprice * 100) AS BIGINT) // 100) % 1000 AS VARCHAR) END
          || '.' || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0')
    END AS price_text,
    CASE WHEN l_quantity <= 45 THEN CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) || '%' END AS discount_text,
    CASE WHEN l_returnflag = 'R' THEN 'Yes' WHEN l_returnflag = 'A' THEN 'no' END AS returned,
    CASE WHEN l_discount <> 0.0 THEN strftime(l_shipdate, '%d/%m/%Y') END AS ship_text,
    CASE WHEN l_tax <> 0.0 THEN l_linestatus END AS status,
    CASE WHEN l_discount <> 0.1 THEN l_quantity END AS qty,
    CAST(l_partkey AS VARCHAR) AS part_ref
  FROM lineitem)
"""


# The given tables' columns (as read from sf0.001); used to write oracle SQL over them.
GIVEN_SCHEMAS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
