"""op6 against a brute-force grouping."""

import hashlib
import random
from collections import defaultdict

import pytest

from sheetwise.llm.exact_dedup import exact_dedup, filter_bits


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        norm = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups[hashlib.sha256(norm.encode()).hexdigest()].append((doc_id, text or ""))
    out = []
    for sha, members in groups.items():
        keep, best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        out += [(d, keep, len(members), d == keep and len(t) == len(best), sha) for d, t in members]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decisions(spark, limit):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a b", "ab", " a\tb ", "c", "é d", f"only {i}"]) + " " * rnd.randint(0, 3)) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, "c"), (1003, "x" * 50_000), (1004, "x " * 50_000),
             (1005, "a b"), (1006, "twin"), (1006, "twin"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(exact_dedup(df, max_broadcast_words=limit)) == brute(rows)


def test_a_small_filter_only_sends_more_rows_on(spark):
    rows = [(i, f"text {i // 2}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(exact_dedup(df, bits_per_row=1)) == brute(rows)
    assert filter_bits(0) == filter_bits(1) == 1 << 16
    assert filter_bits(10**15) == 1 << 36


def test_clashing_and_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a", "k", True), (2, "a", "l", False)],
                               "doc_id long, text string, KEEP_ID string, kept boolean")
    out = exact_dedup(df)
    assert out.columns == ["doc_id", "text", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in out.collect()) == [(1, 1, True), (2, 1, False)]
    assert exact_dedup(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    plan = exact_dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
