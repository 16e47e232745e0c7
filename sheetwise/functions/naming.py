"""Column-name rules: they read ``df.schema`` only, never the data.

Rules P15 (rate-like metric), P9's name half (identifier names), P8's metric-name tiers,
P10 (default date column), P16 (readable labels) and T4 (forecast metric from a goal text).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# These word lists must equal the reference's for the same column choices.
# ---------------------------------------------------------------------------------------------
METRIC_NAME_HINTS_TIER1 = frozenset({"sales", "revenue", "amount", "total", "profit", "spend", "balance"})
METRIC_NAME_HINTS_TIER2 = frozenset({"quantity", "qty", "units", "volume", "price", "cost", "value"})
ID_NAME_HINTS = frozenset({"id", "number", "no", "code", "invoice", "sku", "reference", "ref"})
RATE_NAME_HINTS = frozenset({
    "price", "cost", "rate", "ratio", "percent", "percentage", "score", "index",
    "avg", "average", "mean", "age", "temperature", "cpi", "apr", "margin",
})
# ---------------------------------------------------------------------------------------------

_CAMEL_BOUNDARY = re.compile(r"([a-z0-9])(?=[A-Z])")
_ALNUM_RUN = re.compile(r"[a-z0-9]+")

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
                 T.DecimalType)
TEXT_TYPES = (T.StringType, T.VarcharType, T.CharType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def name_tokens(name) -> list[str]:
    """Lower-case word tokens of a column name: a camelCase boundary (lower/digit then upper)
    starts a new word, and every character outside ASCII a-z0-9 separates words."""
    spaced = _CAMEL_BOUNDARY.sub(r"\1 ", str(name))
    return _ALNUM_RUN.findall(spaced.lower())


def name_tokens_col(name_col: Column) -> Column:
    """The same tokenisation as a Spark expression (array<string>), for column catalogs."""
    spaced = F.regexp_replace(name_col, r"([a-z0-9])(?=[A-Z])", "$1 ")
    parts = F.split(F.lower(spaced), r"[^a-z0-9]+")
    return F.filter(parts, lambda p: p != F.lit(""))


def is_rate_like(name) -> bool:
    """Averaged (not summed) when the name has a rate/price/score-like word."""
    return bool(RATE_NAME_HINTS.intersection(name_tokens(name)))


def has_identifier_name(name) -> bool:
    return bool(ID_NAME_HINTS.intersection(name_tokens(name)))


def is_internal(name) -> bool:
    return str(name).startswith("_")


def numeric_columns(df: DataFrame, include_internal: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and (include_internal or not is_internal(f.name))]


def text_columns(df: DataFrame, include_internal: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, TEXT_TYPES) and (include_internal or not is_internal(f.name))]


def boolean_columns(df: DataFrame, include_internal: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.BooleanType) and (include_internal or not is_internal(f.name))]


def category_columns(df: DataFrame) -> list[str]:
    """Text and boolean columns in schema order, internal ones left out."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, TEXT_TYPES + (T.BooleanType,)) and not is_internal(f.name)]


def default_date_column(df: DataFrame) -> str | None:
    """P10: the first timestamp-typed column."""
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return f.name
    return None


#: What a readable label is cut from: runs of separators, and the places where a word starts.
_SEPARATORS = str.maketrans("_-", "  ")
_WORD_START = re.compile(r"(?<=[^A-Z0-9\s])(?=[A-Z])")


def humanize(name) -> str:
    """Separators become spaces, a capital after a lower-case letter starts a new word, and words
    are capitalised ("fuelPrice" -> "Fuel Price", "net_SALES" -> "Net Sales")."""
    words = _WORD_START.sub(" ", str(name).translate(_SEPARATORS)).split(" ")
    return " ".join(w for w in words if w).title()


def pick_forecast_metric(numeric_cols: list[str], labels: dict | None, goal: str | None) -> str | None:
    """T4: of the numeric columns, the first one of which a label word (three letters or more) occurs
    in the goal text; the first one when none does or there is no goal."""
    def named(column: str) -> bool:
        label = (labels or {}).get(column, column)
        long_words = (w for w in re.split(r"\W+", str(label).casefold()) if len(w) >= 3)
        return any(map((goal or "").casefold().__contains__, long_words))

    return next(filter(named, numeric_cols), next(iter(numeric_cols), None))


def require_columns(df: DataFrame, *cols: str | None) -> None:
    missing = [c for c in cols if c is not None and c not in df.columns]
    if missing:
        raise ValueError(f"columns not found in DataFrame: {missing}")
