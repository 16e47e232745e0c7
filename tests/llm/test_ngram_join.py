"""op3 against all pairs on a small corpus."""

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from sheetwise.llm import ngram_join
from sheetwise.llm.components import connected_components
from sheetwise.llm.ngram_join import (Bands, can_be_similar, flagged_in_block, folded, links_in_block, near_duplicates,
                                      odd_sketch, signatures, sketch_bits)


def sets_of(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, num, den):
    sets = [sets_of(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for e in s:
            holders[e].append(i)
    for i, s in enumerate(sets):
        common = Counter(j for e in s for j in holders[e] if j < i)
        for j, c in common.items():
            if den * c >= num * (len(s) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rnd, rows, k = random.Random(seed), [], 0

    def add(words):
        nonlocal k
        rows.append((k * 7 % 10007, " ".join(words)))
        k += 1

    base = [f"b{i}" for i in range(140)]
    for edits in (1, 4, 9):
        for _ in range(40):
            w = list(base)
            for _ in range(rnd.randint(0, edits)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(30)}"
            add(w)
    for size in range(1, 60):
        b = [f"s{size}_{i}" for i in range(size)]
        for _ in range(3):
            w = list(b)
            if rnd.random() < .7:
                w[rnd.randrange(size)] = f"q{rnd.randrange(3)}"
            if rnd.random() < .5:
                w.append("z")
            add(w)
    passage = [f"common{i}" for i in range(60)]
    for i in range(40):
        add([f"own{i}_{j}" for j in range(rnd.randint(20, 200))] + passage)
    for t in ("", "  \n", "One", "one ", "é x"):
        add([t])
    return rows


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 4, 5)])
def test_components(spark, n, num, den):
    rows = corpus(n)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = near_duplicates(df, n=n, num=num, den=den)
    assert sorted(map(tuple, out.collect())) == brute(rows, n, num, den)


def test_blocks_and_shuffled_texts_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "MAX_BROADCAST_ROWS", 0)
    rows = corpus(8)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, near_duplicates(df).collect())) == brute(rows, 4, 85, 100)


def test_similar_sets_share_a_signature():
    rnd = np.random.default_rng(1)
    for num, den in ((85, 100), (4, 5)):
        bands = Bands(num, den)
        for _ in range(400):
            size = int(rnd.integers(1, 400))
            a = np.unique(rnd.integers(0, 1 << 63, size).astype(np.uint64))
            keep = rnd.random(len(a)) > rnd.random() * .2
            b = np.unique(np.concatenate([a[keep], rnd.integers(0, 1 << 63, int(rnd.integers(0, 1 + size // 8))).astype(np.uint64)]))
            inter = len(np.intersect1d(a, b))
            union = len(a) + len(b) - inter
            if union and inter * den >= union * num and len(np.setxor1d(a, b)):
                assert len(np.intersect1d(signatures(a, bands), signatures(b, bands)))


def test_links_in_block_counts_through_differences():
    pivot = set(range(100))
    members = [pivot - set(range(20)), pivot - set(range(19)), pivot - {1}, set(range(500, 590))]
    pdf = pd.DataFrame({"vertex": range(4), "size": [len(m) for m in members],
                        "linked": [False, False, True, False], "diff": [sorted(m ^ pivot) for m in members],
                        "root": range(4), "part": [0] * 4})
    assert links_in_block(pdf, 85, 100) == [(0, 1)] or links_in_block(pdf, 85, 100) == [(1, 0)]


def test_connected_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    out = connected_components(spark.createDataFrame(edges, "u long, v long"))
    got = {r.v: r.root for r in out.collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, "x"), (None, "a b c d e", "y"), (5, "a b c d e", "y"), (5, "a b c d e", "y"), (2, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (None, 2, 5), (5, 2, 5), (5, 2, 5), (2, 0, 2)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_sets_without_an_id_link_others(spark):
    base, rows, want = [f"w{i}" for i in range(100)], [], []
    for g in range(6):  # the ends of each group are similar to the middle text only, which has no id
        words = [f"g{g}{w}" for w in base]
        for k, (doc, text) in enumerate(((10 * g + 1, ["y", *words[8:]]), (None, words), (10 * g + 2, [*words[:-8], "z"]))):
            rows += [(doc, " ".join(text))] * (2 if k == 1 else 1)
        sizes = [len(sets_of(t, 4)) for _, t in rows[-4:]]
        want += [(d, s, 10 * g + 1) for (d, _), s in zip(rows[-4:], sizes, strict=True)]
    for text in (base, base[1:]):  # none has an id
        rows.append((None, " ".join(text)))
        want.append((None, len(text) - 3, None))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, near_duplicates(df).collect()), key=str) == sorted(want, key=str)


def sets_in_chains(seed, count=60):
    """Sets of many sizes, each a small change of an earlier one or a new one."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        if out and rng.random() < 0.7:
            old = out[rng.integers(len(out))]
            keep = old[rng.random(len(old)) > rng.choice([0.0, 0.05, 0.1, 0.3])]
            more = rng.integers(0, 2 ** 64, max(1, int(len(old) * rng.choice([0.0, 0.05, 0.1]))), np.uint64)
            out.append(np.unique(np.concatenate([keep, more])))
        else:
            out.append(np.unique(rng.integers(0, 2 ** 64, int(rng.choice([1, 5, 40, 300, 3000, 9000])), np.uint64)))
    return out


def similar(a, b, num, den):
    inter = len(np.intersect1d(a, b))
    return inter * den >= (len(a) + len(b) - inter) * num


def test_sketches_never_lose_a_similar_pair():
    kept = dropped = 0
    for seed in range(4):
        sets = sets_in_chains(seed)
        for i, a in enumerate(sets):
            assert sketch_bits(len(a)) == 8 * len(odd_sketch(a)) and folded(odd_sketch(a), 256) < 1 << 256
            for b in sets[:i]:
                can = can_be_similar(len(a), odd_sketch(a), len(b), odd_sketch(b), 4, 5)
                assert can or not similar(a, b, 4, 5)
                kept, dropped = kept + can, dropped + (not can)
    assert dropped > 10 * kept
    assert can_be_similar(1, None, 9, odd_sketch(sets[0]), 4, 5)


def test_blocks_flag_every_member_with_a_similar_one():
    for seed in range(4):
        sets = sets_in_chains(seed, 50)
        rng = np.random.default_rng(seed)
        can = rng.random(len(sets)) < 0.3
        for parts in (1, 2):
            part = rng.integers(0, parts, len(sets))
            pdf = pd.DataFrame({"vertex": np.arange(len(sets)), "can": can, "size": [len(s) for s in sets], "part": part,
                                "sketch": [None if i == 3 else odd_sketch(s) for i, s in enumerate(sets)]})
            got = set(flagged_in_block(pdf, 4, 5).tolist())
            for i in range(len(sets)):
                for j in range(i):
                    if similar(sets[i], sets[j], 4, 5) and not (can[i] and can[j]) and (parts == 1 or part[i] != part[j]):
                        assert {i, j} <= got
    assert flagged_in_block(pdf[:0], 4, 5).tolist() == []
