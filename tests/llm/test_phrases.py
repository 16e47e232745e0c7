"""op13: every phrase counted plainly, over small chunks, hot prefixes and full bitmaps."""

import random
import re
from collections import Counter

import pytest

from sheetwise.llm import phrases
from sheetwise.llm.phrases import collocations, phrase_counts


def plain(rows, min_count, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i:i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    out = {}
    for (lang, ws), a in cand.items():
        inside = any(g == lang and len(v) > len(ws) and any(v[i:i + len(ws)] == ws for i in range(len(v))) and 100 * b >= 80 * a
                     for (g, v), b in cand.items())
        if inside:
            continue
        score, k = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s)
            for lang, all_ in out.items() for i, (s, a, p, l, r) in enumerate(sorted(all_)[:top])}


@pytest.mark.parametrize("seed,chunk,bits", [(1, 50, 1 << 28), (2, 10**6, 1 << 16), (3, 300, 64)])
def test_against_plain_counting(spark, monkeypatch, seed, chunk, bits):
    monkeypatch.setattr(phrases, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(phrases, "MAX_BITS", bits)  # 64 bits: nothing is pruned
    monkeypatch.setattr(phrases, "CHUNK_TEXT", 200)
    rnd = random.Random(seed)
    words = ["the", "The", "of", "a", "New", "york", "city", "é", "É", "in", "\xa0", "x'y", "“q”"]

    def text():
        out = []
        for _ in range(rnd.randint(0, 80)):
            out.append(rnd.choice([*words[:rnd.randint(1, len(words))], "new York City hall", "a a a a"]))
            out.append(rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; "]))
        return "".join(out)

    rows = [(rnd.choice(["en", "en", "de", None, "und"]), text()) for _ in range(120)]
    rows += [("en", None), (None, None), ("fr", ""), ("fr", " .,"), ("en", "new york city " * 2000)] + [rows[0]] * 5
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS phrase", "2 AS f", "3 AS n")
    for min_count, top in ((3, 10**6), (30, 7)):
        got = {tuple(r) for r in collocations(df.repartition(3), min_count, top).collect()}
        assert got == plain(rows, min_count, top)


def test_hot_prefixes_are_cut_and_merged(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HOT_SHARE", 4)
    rows = [("en", f"a w{i % 40} a a b") for i in range(400)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    found, totals = phrase_counts(df, 5)
    got = {r.phrase: r.f for r in found.collect()}
    assert got["a"] == 1200 and got["a a"] == 400 and got["a w7"] == 10 and got["w7 a a b"] == 10 and got["a w7 a a"] == 10
    assert totals.first().n == 2000


def test_empty(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations(df).count() == 0
    assert collocations(spark.createDataFrame([(None, None), ("en", "")], df.schema)).count() == 0
