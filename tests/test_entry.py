import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) == {"p_brand", "total", "share_pct"}


def test_oracles_are_for_registered_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
