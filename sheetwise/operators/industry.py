"""P12 (re-aimed): industry of each table from its column names, for a whole column catalog.

catalog(table, column) -> name tokens (``regexp_replace``/``split``/``explode``) -> distinct
(table, token) -> broadcast join to the fixed keyword table (under 100 rows: a proven bound) ->
points per (table, industry) -> the leader per table if it has >= 3 points and leads the
runner-up by >= 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetwise.functions.naming import name_tokens_col

# ---------------------------------------------------------------------------------------------
# Industry keywords; strong hits score 3 points, weak hits 1.
# ---------------------------------------------------------------------------------------------
INDUSTRY_OPTIONS = {
    "sales_retail": "Sales & Retail Business",
    "finance_banking": "Finance & Banking",
    "engineering_manufacturing": "Engineering & Manufacturing",
    "healthcare": "Healthcare",
}
INDUSTRY_KEYWORDS = {
    "sales_retail": {
        "strong": ["sales", "revenue", "customer", "product", "sku", "order", "cart", "discount", "store",
                   "retail", "purchase", "checkout", "promotion", "coupon", "shipping", "msrp", "basket"],
        "weak": ["price", "quantity", "units", "qty", "category", "region"],
    },
    "finance_banking": {
        "strong": ["loan", "credit", "debit", "balance", "account", "interest", "emi", "mortgage",
                   "portfolio", "fraud", "atm", "deposit", "withdrawal", "apr", "principal", "collateral",
                   "borrower", "lender", "dividend", "currency", "equity"],
        "weak": ["transaction", "amount", "bank", "payment", "risk"],
    },
    "engineering_manufacturing": {
        "strong": ["machine", "sensor", "vibration", "downtime", "defect", "yield", "batch", "production",
                   "plant", "equipment", "maintenance", "failure", "rpm", "throughput", "assembly",
                   "calibration", "tolerance", "scrap", "uptime", "iot"],
        "weak": ["temperature", "pressure", "line", "cycle", "unit"],
    },
    "healthcare": {
        "strong": ["patient", "diagnosis", "admission", "discharge", "physician", "ward", "treatment",
                   "medication", "symptom", "blood", "hospital", "condition", "dosage", "prescription",
                   "readmission", "triage", "icd", "vital", "nurse", "doctor"],
        "weak": ["department", "insurance", "billing", "gender"],
    },
}
STRONG_POINTS, WEAK_POINTS = 3, 1
MIN_SCORE, MIN_LEAD = 3, 2
# ---------------------------------------------------------------------------------------------


def keyword_table(spark: SparkSession) -> DataFrame:
    rows = [(ind, kw, STRONG_POINTS if kind == "strong" else WEAK_POINTS)
            for ind, kinds in INDUSTRY_KEYWORDS.items() for kind, kws in kinds.items() for kw in kws]
    return spark.createDataFrame(rows, "industry string, keyword string, points int")


def catalog_of(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, column)`` rows from the schemas of named tables."""
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame([(t, c) for t, df in tables.items() for c in df.columns],
                                 "table string, column string")


def industry_scores(catalog: DataFrame) -> DataFrame:
    """``table, industry, score, matched`` for every industry with at least one hit."""
    spark = catalog.sparkSession
    tokens = (catalog.where(~F.col("column").startswith("_"))
                     .select("table", F.explode(name_tokens_col(F.col("column"))).alias("keyword"))
                     .distinct())
    return (tokens.join(F.broadcast(keyword_table(spark)), "keyword")
                  .groupBy("table", "industry")
                  .agg(F.sum("points").alias("score"),
                       F.array_sort(F.collect_list("keyword")).alias("matched")))


def classify_tables(catalog: DataFrame) -> DataFrame:
    """``table, industry, score, matched`` per table; industry and matched are NULL when no
    industry is a clear, confident match."""
    scores = industry_scores(catalog)
    order = list(INDUSTRY_OPTIONS)
    pos = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("industry"))
    w = Window.partitionBy("table").orderBy(F.col("score").desc(), pos)  # at most 4 rows per table
    ranked = (scores.withColumn("_r", F.row_number().over(w))
                    .withColumn("_runner", F.lead("score").over(w)))
    lead = ranked.where(F.col("_r") == 1)
    ok = (F.col("score") >= MIN_SCORE) & (F.col("score") >= F.coalesce(F.col("_runner"), F.lit(0)) + MIN_LEAD)
    decided = lead.select("table", F.when(ok, F.col("industry")).alias("industry"),
                          F.col("score").cast("long").alias("score"),
                          F.when(ok, F.col("matched")).alias("matched"))
    tables = catalog.select("table").distinct()
    return tables.join(decided, "table", "left").select(
        "table", "industry", F.coalesce(F.col("score"), F.lit(0)).alias("score"), "matched")
