"""The prefix trie of conversations: ternary search trees per range shard, merged at the shards' ends.

Turns are dictionary-encoded: distinct (role, text) pairs in their order get increasing ids, so
sequences of ids sort as the turns do. Conversations, as sequences of ids, are dealt into shards by
ranges of their order (equal ones by conversation id, so a large group of copies is split too). A task builds a
ternary search tree of its shard, inserting the median of the sorted sequences first, then the
medians of both halves and so on, which keeps the sibling trees balanced; one pass over its nodes
from the last to the first then adds members, leaves and savings up to the parents.

Only nodes on the path of a shard's first or last sequence can lie in other shards as well. Tasks
return these as partial sums: they are added by node, and their totals are carried to their
ancestors among them (a table of shards times depth, in Spark, never on the driver).

Long conversations are cut into segments of :data:`SEGMENT` turns, one trie below another: what
begins with the same whole segments goes on under one node of the next level; a conversation that
nobody shares its beginning with any more needs no tree, its nodes follow from its turns alone. So
neither a long conversation nor a large group is ever in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import map_arrow, written
from sheetwise.operators.sequence import with_position

#: Turns in a segment, and about so many turns in a shard (what a task holds at a time).
SEGMENT = 256
SHARD_TURNS = 200_000
#: Code points of a turn that decide its range of the dictionary (whole texts are sorted within).
RANGE_CHARS = 200
#: Up to so many boundary nodes are broadcast to look up their smallest member.
MAX_BROADCAST_NODES = 200_000
#: Conversation ids in one piece of a list that several shards make.
IDS_A_CHUNK = 4000

_NODE = ("depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string")
#: A task's rows: finished nodes (key is NULL; parent_key where only the merge knows the parent), partial
#: nodes (key, ancestors up to the root, words; pay_ columns are those of the levels below), pieces of member lists (ids).
_ROWS = (_NODE + ", parent_key binary, key binary, ancestors array<binary>, words long, prefix long, "
         "pay_children long, pay_leaves long, pay_saved long, ids string")
NODE_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
_ARROW = {c.split()[0]: _TYPES[c.split()[1]] for c in _ROWS.split(", ")}
_NONE = hashlib.sha256(b"").hexdigest()


def dictionary(turns: DataFrame) -> DataFrame:
    """``turns`` (role, text) to ``key`` (a SHA-256), ``id`` in the order of (role, text), ``words``."""
    ordered = (turns.select("role", "text").distinct()
               .repartitionByRange("role", F.substring("text", 1, RANGE_CHARS)).sortWithinPartitions("role", "text"))
    return written(ordered.select(
        _key(), F.monotonically_increasing_id().alias("id"),
        F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")), "turns")


def _key():
    return F.unhex(F.sha2(F.concat_ws(":", F.length("role"), "role", "text").cast("binary"), 256)).alias("key")


def encoded_turns(df: DataFrame) -> DataFrame:
    """``df`` (conv_id, turn, role, text) as ``conv_id``, ``pos`` (from 1, by turn with NULL first,
    then role and text), ``id``, ``words``, ``first`` and ``len`` (turns of the conversation). Rows
    without a conversation id belong to none and go; a NULL role or text is empty; repeated rows
    are turns of their own."""
    rows = df.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    coded = rows.select("conv_id", "turn", _key()).join(dictionary(rows), "key").drop("key")
    return with_position(coded, ["conv_id", "turn", "id"], "place")


def rebuilt(df: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Conversations that share openings: conversation c begins with the first ``crc32(c) % heads``
    turns of conversation ``c - c % group`` instead of its own. Returns ``conv_id``, ``total`` (its
    turns), ``pos``, ``id``, ``words``; a conversation left without turns has one row with NULL ``pos``."""
    rows = encoded_turns(df)
    own = rows.groupBy("conv_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("len"))
    own = own.select("*", (F.col("conv_id") - F.col("conv_id") % group).alias("base"),
                     (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    bases = own.where("conv_id = base").select("base", F.col("len").alias("base_len"))
    convs = written(own.join(bases, "base", "left").select(
        "conv_id", "first", "base", "h", F.least("h", F.coalesce("base_len", F.lit(0))).alias("b"), "len")
        .withColumn("total", F.col("b") + F.greatest(F.col("len") - F.col("h"), F.lit(0))), "conversations")
    placed = rows.join(convs.select("conv_id", "first", "h", "b", "total"), "conv_id").withColumn(
        "pos", F.col("place") - F.col("first") + 1)
    later = placed.where("pos > h").select("conv_id", "total", (F.col("pos") - F.col("h") + F.col("b")).alias("pos"), "id", "words")
    opening = placed.where((F.col("pos") < heads) & (F.col("conv_id") % group == 0)).select(
        F.col("conv_id").alias("base"), "pos", "id", "words")
    openings = (convs.where("b > 0").select("conv_id", "total", "base", "b").join(opening, "base")
                .where("pos <= b").select("conv_id", "total", "pos", "id", "words"))
    none = convs.where("total = 0").selectExpr("conv_id", "total", "cast(NULL AS long) AS pos", "cast(NULL AS long) AS id",
                                               "cast(NULL AS long) AS words")
    return later.unionByName(openings).unionByName(none)


class _Trie:
    """The trie of one shard's sequences under one prefix: node 0 is the root; every other node is a
    node of the ternary search tree: ``lo`` and ``hi`` among its siblings, ``eq`` to its children."""

    def __init__(self):
        self.sym, self.lo, self.hi, self.eq = [0], [0], [0], [0]
        self.parent, self.depth, self.words = [-1], [0], [0]
        self.members, self.least = [0], [None]
        self.ends: dict[int, list[int]] = {}
        self.below: dict[int, tuple[int, int, int]] = {}

    def _new(self, sym: int, words: int, parent: int) -> int:
        for column, value in ((self.sym, sym), (self.lo, 0), (self.hi, 0), (self.eq, 0), (self.parent, parent),
                              (self.depth, self.depth[parent] + 1), (self.words, words), (self.members, 0), (self.least, None)):
            column.append(value)
        return len(self.sym) - 1

    def insert(self, ids: list[int], words: list[int], convs: list[int], ends: list[int], below) -> None:
        sym, lo, hi, eq = self.sym, self.lo, self.hi, self.eq
        node, path = 0, [0]
        for s, w in zip(ids, words, strict=True):
            at = eq[node]
            if not at:
                at = eq[node] = self._new(s, w, node)
            while sym[at] != s:
                side = lo if s < sym[at] else hi
                if not side[at]:
                    side[at] = self._new(s, w, node)
                at = side[at]
            node = at
            path.append(node)
        for x in path:
            self.members[x] += len(convs)
            if self.least[x] is None or convs[0] < self.least[x]:
                self.least[x] = convs[0]
        if ends:
            self.ends[node] = ends
        if below:
            self.below[node] = below

    def path(self, ids: list[int]) -> list[int]:
        """The nodes of an inserted sequence, the root first."""
        out = [0]
        for s in ids:
            at = self.eq[out[-1]]
            while self.sym[at] != s:
                at = (self.lo if s < self.sym[at] else self.hi)[at]
            out.append(at)
        return out


def median_order(n: int) -> Iterator[int]:
    """0 .. n-1, the middle first, then the middles of both halves and so on."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            todo += [(middle + 1, b), (a, middle)]


def _tree(rows: list[tuple]) -> _Trie:
    """The trie of sorted rows (conv_id, ids, words, ends, below) of one prefix."""
    groups: list[list] = []
    for conv, ids, words, ends, below in rows:
        if not groups or groups[-1][0] != ids:
            groups.append([ids, words, [], [], None])
        groups[-1][2].append(conv)
        if ends:
            groups[-1][3].append(conv)
        groups[-1][4] = groups[-1][4] or below
    trie = _Trie()
    for i in median_order(len(groups)):
        ids, words, convs, ends, below = groups[i]
        trie.insert(ids, words, sorted(convs), sorted(ends), below)
    return trie


def _shard(trie: _Trie, prefix: int, root_conv: int, start: int, edges: list[list[int]]) -> Iterator[dict]:
    """The rows of one trie of a shard; ``edges`` are the shard's first and last sequence, if of this prefix."""
    n = len(trie.sym)
    partial = {0: _path_key(prefix, [])}
    for ids in edges:
        for d, node in enumerate(trie.path(ids)):
            partial[node] = _path_key(prefix, ids[:d])
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for x in range(n - 1, 0, -1):  # children come after their parents
        if x in partial:
            continue
        if x in trie.below:
            children[x], leaves[x], saved[x] = (a + b for a, b in zip(trie.below[x], (children[x], leaves[x], saved[x]), strict=True))
        elif not children[x]:
            leaves[x] = 1
        saved[x] += (trie.members[x] - 1) * trie.words[x]
        p = trie.parent[x]
        children[p] += 1
        leaves[p] += leaves[x]
        saved[p] += saved[x]
    for x in range(n):
        p = trie.parent[x]
        row = {"depth": start + trie.depth[x], "conv_id": trie.least[x], "n_convs": trie.members[x],
               "n_children": children[x], "n_leaves": leaves[x], "saved_tokens": saved[x]}
        ends = trie.ends.get(x, [])
        if x not in partial:
            known = root_conv if p == 0 else None if p in partial else trie.least[p]
            yield row | {"parent_conv_id": known, "parent_key": partial[p] if known is None else None,
                         "ends_sha256": hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else _NONE}
            continue
        above, at = [partial[x]], x
        while at:
            at = trie.parent[at]
            above.append(partial[at])
        pay = trie.below.get(x, (0, 0, 0))
        yield row | {"key": partial[x], "ancestors": above, "words": trie.words[x], "prefix": prefix,
                     "parent_conv_id": root_conv if x and p == 0 else None,
                     "pay_children": pay[0], "pay_leaves": pay[1], "pay_saved": pay[2]}
        for i in range(0, len(ends), IDS_A_CHUNK):
            part = ends[i:i + IDS_A_CHUNK]
            yield {"key": partial[x], "conv_id": part[0], "ids": ",".join(map(str, part))}


def _path_key(prefix: int, ids: list[int]) -> bytes:
    h = hashlib.sha256(str(prefix).encode())
    for i in ids:
        h.update(b",%d" % i)
    return h.digest()[:16]


def _level(rows: DataFrame, start: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of one level from its segments (prefix, ids, words, conv_id, ends, root_conv, pay_children, pay_leaves,
    pay_saved), and per prefix what lies below its root (pay_ columns)."""
    turns = rows.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    order = ["prefix", "ids", "conv_id"]
    shards = (rows.repartitionByRange(max(1, -(-turns // SHARD_TURNS)), *order).sortWithinPartitions(*order)
              .select("prefix", "ids", "conv_id", "words", "ends", "root_conv", "pay_children", "pay_leaves", "pay_saved"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        out: list[dict] = []
        a = 0
        while a < len(got):
            b = a
            while b < len(got) and got[b][0] == got[a][0]:
                b += 1
            trie = _tree([(conv, ids, words, ends, None if c is None else (c, lv, sv))
                          for _, ids, conv, words, ends, _, c, lv, sv in got[a:b]])
            edges = ([got[a][1]] if a == 0 else []) + ([got[b - 1][1]] if b == len(got) else [])
            for row in _shard(trie, got[a][0], got[a][5], start, edges):
                out.append(row)
                if len(out) == 5000:
                    yield _batch(out)
                    out = []
            a = b
        if out:
            yield _batch(out)

    made = written(map_arrow(shards, run, _ROWS), "trie")
    partial = made.where("key IS NOT NULL AND ids IS NULL")
    merged = written(partial.groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("ancestors", "depth", "words", "prefix")],
        F.min("conv_id").alias("conv_id"), F.first("parent_conv_id", ignorenulls=True).alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        *[F.max(c).alias(c) for c in ("pay_children", "pay_leaves", "pay_saved")])
        .withColumn("parent_key", F.try_element_at("ancestors", F.lit(2))), "boundary")
    kids = merged.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    whole = merged.join(kids, "key", "left").withColumn(
        "n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)) + F.col("pay_children"))
    sums = (whole.select(
        F.explode("ancestors").alias("key"),
        (F.col("n_leaves") + F.col("pay_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("pay_saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
        .groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    whole = whole.drop("n_leaves", "saved_tokens").join(sums, "key").join(_digests(made), "key", "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE)))
    totals = whole.where("parent_key IS NULL").select(
        "prefix", F.col("n_children").alias("pay_children"), F.col("n_leaves").alias("pay_leaves"),
        F.col("saved_tokens").alias("pay_saved"))
    if start:  # these roots are nodes of the level above
        whole = whole.where("parent_key IS NOT NULL")
    inner = made.where("key IS NULL")
    nodes = inner.select(*NODE_COLUMNS, "parent_key").unionByName(whole.select(
        *NODE_COLUMNS, F.when(F.col("parent_conv_id").isNull(), F.col("parent_key")).alias("parent_key")))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"))
    if merged.count() <= MAX_BROADCAST_NODES:
        parents = F.broadcast(parents)
    nodes = nodes.join(parents, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "found"))
    return nodes.select(*NODE_COLUMNS), totals


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _ARROW[c]) for c in _NAMES], names=_NAMES)


def _digests(made: DataFrame) -> DataFrame:
    """SHA-256 of the member lists that shards have made pieces of: key, ends_sha256. Pieces stream
    through the hash in order, whatever their number."""
    pieces = (made.where("ids IS NOT NULL").select("key", "conv_id", "ids")
              .repartition("key").sortWithinPartitions("key", "conv_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        keys, digests = [], []
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k == key:
                    h.update(b",")
                else:
                    if key is not None:
                        keys.append(key)
                        digests.append(h.hexdigest())
                    key, h = k, hashlib.sha256()
                h.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())],
                                             names=["key", "ends_sha256"])
            keys, digests = [], []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])],
                                             names=["key", "ends_sha256"])

    return map_arrow(pieces, run, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, segment: int | None = None) -> DataFrame:
    """The nodes of the prefix trie of ``turns`` (see :func:`rebuilt`): ``depth``, ``conv_id`` (the
    smallest member), ``parent_conv_id`` (NULL at the root), ``n_convs``, ``n_children``,
    ``n_leaves`` (childless nodes of the subtree), ``saved_tokens`` (over the subtree, words of a
    node's turn times its other members) and ``ends_sha256`` (of the comma-joined ids of members that end here).
    Equal conversations are members of one node; one without turns is a member of the root alone; no
    conversations: no nodes."""
    size = segment or SEGMENT
    cut = turns.withColumn("k", F.floor((F.coalesce("pos", F.lit(1)) - 1) / size))
    one = F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id", "words"))))
    segments = written(cut.groupBy("conv_id", "k").agg(F.max("total").alias("total"), one.alias("s")).select(
        "conv_id", "k", "total", F.transform("s", lambda t: t["id"]).alias("ids"),
        F.transform("s", lambda t: t["words"]).alias("words")), "segments")
    found = segments.agg(F.max("total").alias("most"), F.min("conv_id").alias("least")).first()
    least = found.least if found.least is not None else 0
    # down the levels: who goes on under which node
    level = segments.where("k = 0").withColumn("prefix", F.lit(0).cast("long")).withColumn("root_conv", F.lit(least).cast("long"))
    levels, tails = [], []
    for k in range(max(1, -(-(found.most or 0) // size))):
        goes_on = F.col("total") > (k + 1) * size
        if (found.most or 0) <= (k + 1) * size:
            levels.append((level, None))
            break
        full = level.where(F.size("ids") == size).groupBy("prefix", "ids").agg(
            F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("next_root"), F.max(goes_on).alias("on"))
        ends = written(full.where("on").select("prefix", "ids", "n", "next_root", F.monotonically_increasing_id().alias("next")), "ends")
        stepped = written(level.where(goes_on).join(ends, ["prefix", "ids"])
                          .select("conv_id", "n", "next", "next_root"), "steps")
        levels.append((level, stepped))
        tails.append((k, stepped.where("n = 1").select("conv_id")))
        level = (segments.where(F.col("k") == k + 1).join(stepped.where("n > 1"), "conv_id")
                 .select("conv_id", "k", "total", "ids", "words", F.col("next").alias("prefix"), F.col("next_root").alias("root_conv")))
        if not level.take(1):
            break
    # and up again: what lies below a node of the next level is known before its own level is built
    pays = ["pay_children", "pay_leaves", "pay_saved"]
    none = [F.lit(None).cast("long").alias(c) for c in pays]
    nodes, below = [], None
    for k in range(len(levels) - 1, -1, -1):
        level, stepped = levels[k]
        rows = level.withColumn("ends", F.col("total") <= (k + 1) * size)
        if stepped is None:
            rows = rows.select("*", *none)
        else:  # a conversation alone goes on in one line: one child, one leaf, nothing saved
            lone = stepped.where("n = 1").select("conv_id", *[F.lit(v).cast("long").alias(c) for c, v in zip(pays, (1, 1, 0), strict=True)])
            if below is not None:
                shared = stepped.where("n > 1").join(below.withColumnRenamed("prefix", "next"), "next").select("conv_id", *pays)
                lone = lone.unionByName(shared)
            rows = rows.join(lone, "conv_id", "left")
        made, below = _level(rows, k * size)
        nodes.append(made)
    for k, alone in tails:
        pos = F.col("pos") + 1 + F.col("k") * size
        ended = pos == F.col("total")
        nodes.append(segments.where(F.col("k") > k).join(alone, "conv_id").select(
            "conv_id", "total", "k", F.posexplode("ids").alias("pos", "id")).select(
            pos.cast("long").alias("depth"), "conv_id", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
            F.when(ended, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
            F.lit(0).cast("long").alias("saved_tokens"),
            F.when(ended, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(_NONE).alias("ends_sha256")))
    out = nodes[0]
    for part in nodes[1:]:
        out = out.unionByName(part)
    return out
