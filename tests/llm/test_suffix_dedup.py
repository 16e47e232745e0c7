"""op9 against every run of fifty words."""

import random
from collections import defaultdict

import numpy as np

from sheetwise.llm.shingles import word_hashes
from sheetwise.llm.suffix_dedup import minimisers, repeated_passages, without_repeats


def brute(rows, size=50):
    where, words = defaultdict(set), {}
    for d, t in rows:
        w = words[d] = (t or "").encode().lower().split()
        for i in range(len(w) - size + 1):
            where[tuple(w[i:i + size])].add(d)
    out = []
    for d, w in words.items():
        spans = []
        for i in range(len(w) - size + 1):
            docs = where[tuple(w[i:i + size])]
            if len(docs) < 2:
                continue
            if spans and i <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + size, min(spans[-1][2], *docs))
            else:
                spans.append((i, i + size, min(docs)))
        out += [(d, a, b - a, f) for a, b, f in spans]
    return sorted(out)


def corpus(seed):
    rnd, rows = random.Random(seed), []
    passages = [[rnd.choice([f"p{i}" for i in range(300)]) for _ in range(rnd.randint(45, 70))] for _ in range(10)]
    for k in range(150):
        w = []
        for _ in range(rnd.randint(1, 4)):
            w += [f"u{rnd.randrange(10**9)}" for _ in range(rnd.randint(0, 30))]
            p = rnd.choice(passages)
            w += p[rnd.randint(0, 8):len(p) - rnd.randint(0, 8)]
        rows.append((k * 31 % 1009, " ".join(w)))
    rows += [(2000 + i, " ".join(rnd.choice("ab") for _ in range(60))) for i in range(8)]
    rows += [(3000, "x " * 200), (3001, "x " * 130), (3002, "y " * 49), (3003, "y " * 49), (3004, None), (3005, ""),
             (3006, "z " * 50), (3007, "Z\t" * 50), (3008, rows[0][1]), (3009, rows[0][1])]
    return rows


def test_passages(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert sorted(map(tuple, repeated_passages(df).collect())) == brute(rows)


def test_minimisers_are_the_leftmost_lowest():
    rnd = random.Random(3)
    for size, k in ((50, 16), (20, 5), (9, 9), (10, 9), (64, 1)):
        h = word_hashes(" ".join(rnd.choice("abcdef") for _ in range(200)))
        at, grams = minimisers(h, size, k)
        width = size - k + 1
        assert at.tolist() == [i + int(np.argmin(grams[i:i + width])) for i in range(len(h) - size + 1)]
    assert len(minimisers(h[:30], 50, 16)[0]) == 0


def test_nulls_clashes_empty(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, 5), (2, "a " + text, 6), (2, "a " + text, 6), (None, text, 7), (3, None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, first_word int")
    got = sorted(map(tuple, repeated_passages(df).collect()))
    assert got == [(1, 0, 80, 1), (2, 1, 80, 1)]
    assert repeated_passages(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(1, text + " " + text)], "doc_id long, text string")
    assert repeated_passages(alone).count() == 0  # a document repeating itself shares nothing


def test_every_copy_within_a_document(spark):
    x = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join([*x, "sep", *x, "other", *x[20:180]])),
            (2, " ".join([f"a{i}" for i in range(40)] + x[70:130] + [f"b{i}" for i in range(40)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, repeated_passages(df).collect())) == brute(rows)
    assert len(brute(rows)) == 4


def test_cutting(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "start " + text), (2, "own words " + text + " end"), (3, "just this"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in without_repeats(df, repeated_passages(df)).collect()}
    assert got == {1: "start " + text, 2: "own words end", 3: "just this", 4: None}


def test_query(spark):
    import __spark_entry__ as entry
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted(map(tuple, entry.queries()["op9_suffix_array_dedup"](spark, d).collect()))
    assert got == brute(rows) and got
