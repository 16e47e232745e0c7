"""Radix selection of quantiles against NumPy."""

import math
import random

import numpy as np
import pytest

from sheetwise.functions import quantiles as Q


def test_image_keeps_the_order():
    values = [-math.inf, -1e308, -2.5, -5e-324, 0.0, 5e-324, 1.0, math.nextafter(1.0, 2), 1e308, math.inf]
    images = Q.order_image(np.array(values)).tolist()
    assert images == sorted(set(images)) and [Q.image_value(i) for i in images] == values
    assert Q.order_image(np.array([-0.0, 0.0])).tolist() == [1 << 63] * 2
    assert Q.image_value(0) == -math.inf and Q.image_value(2 ** 64 - 1) == math.inf


@pytest.mark.parametrize("max_bracket", [1, 7, 50_000])
def test_against_numpy(spark, max_bracket):
    rnd = random.Random(4)
    rows = [(rnd.gauss(0, 1e6), rnd.choice([1, 2, 2, 3]), rnd.choice([None, math.nan, -0.0, 0.0, 5.5]), None,
             rnd.choice([rnd.random() * 1e-9 + 1, 1.0, -math.inf, 7e300]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "a double, `b b` int, c double, d double, e double, i long").repartition(5)
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = Q.exact_quantiles(df, df.columns, probs, max_bracket=max_bracket)
    for k, c in enumerate(df.columns):
        v = np.array([r[k] for r in rows if r[k] is not None and r[k] == r[k]], float)
        if not len(v):
            assert got[c] == [None] * len(probs)
            continue
        v.sort()
        for p, q in zip(probs, got[c], strict=True):
            pos = p * (len(v) - 1)
            lo, hi = v[int(pos)], v[min(int(pos) + 1, len(v) - 1)]
            assert q == (lo if lo == hi else lo + (hi - lo) * (pos - int(pos)))


def test_no_columns_no_rows_many_columns(spark, monkeypatch):
    monkeypatch.setattr(Q, "COLUMNS_AT_ONCE", 3)
    df = spark.range(11).selectExpr(*[f"id * {k} AS c{k}" for k in range(8)])
    assert Q.exact_quantiles(df, df.columns, [0.5]) == {f"c{k}": [5.0 * k] for k in range(8)}
    assert Q.exact_quantiles(df, [], [0.5]) == {}
    assert Q.exact_quantiles(df.limit(0), ["c1"], [0.5]) == {"c1": [None]}


def test_rows_of_few_groups_are_not_dealt_by_group(spark, monkeypatch):
    rows = [(k, float(v * v % 37)) for k in ("a", "b") for v in range(90)] + [("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    sent, broadcast = [], Q.F.broadcast
    monkeypatch.setattr(Q.F, "broadcast", lambda d: sent.append(d.columns) or broadcast(d))
    few = sorted(map(tuple, Q.grouped_quantiles(df, ["k"], "v", [0.5, 0.9]).collect()))
    assert any("_lo0" in c for c in sent)
    sent.clear()
    monkeypatch.setattr(Q, "MAX_BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, Q.grouped_quantiles(df, ["k"], "v", [0.5, 0.9]).collect())) == few and not sent
    want = np.quantile([r[1] for r in rows if r[0] == "a"], [0.5, 0.9])
    assert few[0][0] == "a" and np.allclose(few[0][1:], want)
