"""One notion of a missing value, as in pandas: NaN counts as NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame, *cols: str) -> DataFrame:
    """NaN in float columns (of ``cols`` when given) becomes NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and (not cols or f.name in cols):
            c = F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name)
        out.append(c)
    return df.select(*out)
