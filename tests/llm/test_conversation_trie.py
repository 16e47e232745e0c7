"""op11: every node against dictionaries of prefixes, over many shards and segments."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sheetwise.llm import conversation_trie
from sheetwise.llm.conversation_trie import NODE_COLUMNS, _tree, median_order, prefix_trie, rebuilt


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    said = {c: [(r, t) for _, r, t in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = (said.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1].split()) if path else 0
    return sorted((len(p), min(c), min(members[p[:-1]]) if p else None, len(c), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, c in members.items())


def key(row):
    return tuple((x is not None, x) for x in row)


def conversations(seed, convs=70):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(200), convs):
        length = rnd.choice([0, 1, 2, 3, 5, 8, 13])
        same = rnd.random() < 0.6
        for t in range(length):
            text = f"{'same words' if same else rnd.choice(['x', 'y z'])} {t if rnd.random() < 0.9 else rnd.randint(0, 2)}"
            rows.append((c, t if rnd.random() < 0.9 else rnd.choice([None, 1]), rnd.choice(["user", "user", None]),
                         rnd.choice([text, text, text, None, ""])))
    rows += [(None, 0, "user", "nobody"), (5000, 0, "user", "a b"), (5000, 0, "user", "a b")]
    rows += [(c, t, "user", f"copy {t}") for c in range(3000, 3040) for t in range(9)]
    return rows


@pytest.mark.parametrize("seed,segment,shard", [(1, 256, 200_000), (2, 4, 60), (3, 2, 10), (4, 1, 37)])
def test_against_plain_prefixes(spark, monkeypatch, seed, segment, shard):
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", shard)
    monkeypatch.setattr(conversation_trie, "IDS_A_CHUNK", 3)
    rows = conversations(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS pos", "2 AS key")
    got = prefix_trie(rebuilt(df), segment).select(*NODE_COLUMNS).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_empty_and_turnless(spark):
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert prefix_trie(rebuilt(df)).count() == 0
    lonely = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)  # its one turn is replaced by none
    rows = [(lonely, 0, "user", "gone")]
    got = prefix_trie(rebuilt(spark.createDataFrame(rows, df.schema))).select(*NODE_COLUMNS).collect()
    assert list(map(tuple, got)) == plain(rows) and got[0].n_leaves == 1


def test_median_order_balances_the_trees():
    assert sorted(median_order(100)) == list(range(100))
    trie = _tree([(i, [i], [1], True, None) for i in range(1023)])
    depth = {trie.eq[0]: 1}
    for x in range(1, len(trie.sym)):  # siblings come after the one they hang on
        for side in (trie.lo[x], trie.hi[x]):
            if side:
                depth[side] = depth[x] + 1
    assert max(depth.values()) == 10
