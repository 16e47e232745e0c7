"""op4 against every window of every document."""

import random
from collections import Counter

import numpy as np
import pytest

from sheetwise.llm import decontaminate
from sheetwise.llm.decontaminate import BenchmarkIndex, clean_run, find_contamination, fingerprints, similarity
from sheetwise.llm.shingles import shingles, word_hashes


def brute(items, text):
    h, out = word_hashes(text), {}
    for item_id, item in items:
        ih = word_hashes(item)
        if not len(ih) or not len(h):
            continue
        weights = Counter(shingles(ih, 5).tolist())
        best = max(similarity(weights, Counter(shingles(h[s:s + len(ih)], 5).tolist()))
                   for s in range(max(0, len(h) - len(ih)) + 1))
        if best * 5 >= 4:
            out[item_id] = best
    return out


def edited(rnd, words):
    w = list(words)
    for _ in range(rnd.randint(0, 3)):
        k = rnd.randrange(len(w))
        kind = rnd.random()
        if kind < .4:
            w[k] = "zz"
        elif kind < .7 and len(w) > 2:
            del w[k]
        else:
            w.insert(k, "yy")
    return w[rnd.randint(0, 2):]


def cases(seed):
    rnd = random.Random(seed)
    items = [(i, " ".join(f"w{rnd.randrange(400)}" for _ in range(n)))
             for i, n in enumerate([1, 2, 4, 5, 6, 9, 14, 20, 33, 44, 49, 55, 60, 90, 140])]
    items.append((50, "again again " * 12))
    texts = []
    for _ in range(300):
        _, item = rnd.choice(items)
        texts.append(" ".join([f"a{rnd.randrange(99)}" for _ in range(rnd.randint(0, 25))] + edited(rnd, item.split())
                              + [f"b{rnd.randrange(99)}" for _ in range(rnd.randint(0, 25))]))
    return items, texts


@pytest.mark.parametrize("seed", [1, 2])
def test_every_similar_window_is_found(seed):
    items, texts = cases(seed)
    index, hits = BenchmarkIndex(items), 0
    for text, found in zip(texts, index.search(texts), strict=True):
        want = brute(items, text)
        assert {i: round(s, 9) for i, s, *_ in found} == {i: round(s, 9) for i, s in want.items()}
        hits += len(want)
    assert hits > 50


def test_texts_shorter_than_the_item():
    rnd, hits = random.Random(5), 0
    for n in range(1, 130):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        items = [(n, " ".join(words))]
        parts = [words[a:b] for a in range(0, n // 4 + 2) for b in range(n - n // 4 - 1, n + 1) if a < b]
        parts = rnd.sample(parts, min(len(parts), 25)) + [words[:k] for k in range(n * 3 // 4, n)]
        parts += [edited(rnd, p) for p in parts if len(p) > 3]
        texts = [" ".join(p) for p in parts]
        for text, found in zip(texts, BenchmarkIndex(items).search(texts), strict=True):
            want = brute(items, text)
            assert {i: round(s, 9) for i, s, *_ in found} == {i: round(s, 9) for i, s in want.items()}
            hits += len(want)
    assert hits > 1000


def test_clean_run_is_never_above_the_item():
    assert all(1 <= clean_run(n) <= n for n in range(1, 2000))


def test_fingerprints_are_bit_majorities(monkeypatch):
    rnd = np.random.default_rng(3)
    sh = rnd.integers(0, 1 << 63, 300).astype(np.uint64)
    monkeypatch.setattr(decontaminate, "_ROWS", 64)
    got = fingerprints(sh, [1, 2, 7, 130, 299, 301])
    bits = np.unpackbits(sh.view(np.uint8)).reshape(-1, 64)
    for w in (2, 7, 130, 299):
        want = [np.packbits(bits[i:i + w].sum(0) > w // 2).view(np.uint64)[0] for i in range(300 - w + 1)]
        assert got[w].tolist() == want
    assert np.array_equal(got[1], sh) and len(got[301]) == 0


def test_frames(spark, monkeypatch):
    items, texts = cases(7)
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (902, texts[0]), (902, texts[0])],
                                 "doc_id long, text string").selectExpr("*", "'x' AS similarity")
    bench = spark.createDataFrame([*items, (70, None), (71, "  ")], "item_id long, text string")
    want = sorted((d, i) for d, t in [*enumerate(texts), (902, texts[0]), (902, texts[0])] for i in brute(items, t))
    out = find_contamination(docs, bench)
    assert out.columns == ["doc_id", "item_id", "similarity", "first_word", "n_words"]
    assert sorted((r.doc_id, r.item_id) for r in out.collect()) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)  # the benchmark in several passes
    assert sorted((r.doc_id, r.item_id) for r in find_contamination(docs, bench).collect()) == want
    assert find_contamination(docs, bench.limit(0)).count() == 0
    assert find_contamination(docs.limit(0), bench).count() == 0


def test_query_against_brute_force(spark):
    import __spark_entry__ as entry
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = sorted((r.doc_id, i) for r in docs for i in brute(items, r.text))
    got = entry.queries()["op4_decontamination"](spark, d).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == want and want
