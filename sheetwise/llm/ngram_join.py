"""N-gram Jaccard join with PartEnum signatures, and the components its links form.

**Signatures.** Sets are cut into size bands. Within a band, or across the end of one, two sets whose
Jaccard similarity reaches the threshold differ in at most ``k`` elements, where ``k`` follows from the
largest sizes there. The hash domain is cut into ``n1`` partitions of three sub-partitions each, with ``n1`` more
than ``k / 2``: so at least one partition holds at most one differing element, and of the three
subsets of two sub-partitions one holds none. A signature is a set's projection onto such a subset;
sufficiently similar sets share one. A set gives the signatures of its own band and of the band
ends across which a partner is possible. ``n1`` has a few spare partitions, so that empty
projections (which everything shares) are only needed of sets with more empty ones than spare.

**Links.** Sets with one 64-bit digest are one vertex. Within a signature's bucket every member is
compared with one pivot only. Pairs that cannot be similar fall out first, without their texts: a
set's *odd sketch* holds, for every cell of the hash domain, whether it has an odd number of elements there, so two
sketches differ in at most as many bits as the sets differ in elements. What is left is decided on
the exact sets. Where a bucket has more members, those not linked
to their pivot are then compared with the rest of the pivot's members through their *differences* from the pivot, which are
small and give the exact intersection of any two members; that runs in blocks of bounded size and
returns a spanning forest of links, so no pair list of a group is ever formed and no link between
components is lost.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import map_arrow, written
from sheetwise.llm.components import connected_components
from sheetwise.llm.shingles import mix, set_digest, shingle_set

#: Up to so many rows, tables of vertices to fetch texts for and of their roots are broadcast (16 bytes a row).
MAX_BROADCAST_ROWS = 500_000
#: Members of a block in the comparison of a pivot's members.
BLOCK = 1500
MAX_SKETCH = 1 << 16
_MAX_SEEN = 200_000
_U = np.uint64


class Bands:
    """Size bands for similarity ``num / den``, each half as wide again as its smallest size. A pair of
    similar sets lies inside a band or has one set on either side of a band's lower end."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self._low, self._high = [1], [1]

    def _differ(self, sizes: int) -> int:
        """The most elements in which similar sets of ``sizes`` elements together can differ."""
        return (self.den - self.num) * sizes // (self.den + self.num)

    def of(self, size: int) -> list[tuple[int, int]]:
        """(number, largest difference) of the classes a set of ``size`` gives signatures for: its
        band, and the ends of bands across which it can have a partner."""
        while self._high[-1] * self.num < size * self.den:
            low = self._high[-1] + 1
            self._low.append(low)
            self._high.append(max(low, low * 3 // 2))
        out = []
        for i, (low, high) in enumerate(zip(self._low, self._high, strict=True)):
            if low <= size <= high:
                out.append((2 * i, self._differ(2 * high)))
            most = (low - 1) * self.den // self.num  # of a partner of the largest smaller set
            if low * self.num <= size * self.den and size <= most and low <= most:
                out.append((2 * i + 1, self._differ(low - 1 + most)))
        return out


def partitions(k: int) -> tuple[int, int]:
    """(partitions, spare ones among them) for sets that differ in at most ``k`` elements. So many
    spare ones that hardly a set has more empty projections than them."""
    n1 = k // 2 + 1
    spare = 0 if n1 < 4 else 2 + n1 // 8
    return n1 + spare, spare


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The PartEnum signatures of a sorted set of hashes (none in bands where only equal sets can
    be similar: those are one vertex already)."""
    out = []
    scrambled = np.concatenate([np.zeros(1, _U), np.cumsum(mix(s ^ _U(0x2545F4914F6CDD1D)))])
    for band, k in bands.of(len(s)) if len(s) else ():
        if k == 0:
            continue
        n1, spare = partitions(k)
        part = ((s >> _U(32)) * _U(3 * n1)) >> _U(32)
        at = np.searchsorted(part, np.arange(3 * n1 + 1, dtype=_U))
        total = (scrambled[at[1:]] - scrambled[at[:-1]]).reshape(n1, 3)
        count = np.diff(at).reshape(n1, 3)
        tag = mix(np.arange(n1, dtype=_U) * _U(4) + _U(band << 40))
        sig = np.stack([mix(mix(total[:, a] + tag * _U(3)) + mix(total[:, b] + tag) * _U(5) + _U(a + b))
                        for a, b in ((0, 1), (0, 2), (1, 2))], 1)
        held = np.stack([count[:, a] + count[:, b] for a, b in ((0, 1), (0, 2), (1, 2))], 1)
        # the least elements that more than `spare` partitions have in their thinnest projection
        least = np.partition(held.min(1), spare)[spare]
        sig = sig[held >= least]
        out.append(sig.ravel())
    return np.concatenate(out) if out else np.zeros(0, _U)


def sketch_bits(size: int) -> int:
    """Cells of the sketch of a set: the power of two above twice its size, 256 to 65,536."""
    return min(MAX_SKETCH, max(256, 1 << (2 * size).bit_length()))


def odd_sketch(s: np.ndarray) -> bytes:
    """One bit for every cell: whether an odd number of the set's hashes falls there. Cell = hash modulo
    the number of cells, so a sketch folds to half its cells by combining its halves."""
    m = sketch_bits(len(s))
    odd = np.bincount((s & _U(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").tobytes()


def folded(sketch: bytes, cells: int) -> int:
    """The sketch as an integer of ``cells`` bits."""
    bits, have = int.from_bytes(sketch, "little"), 8 * len(sketch)
    while have > cells:
        have //= 2
        bits = (bits >> have) ^ (bits & ((1 << have) - 1))
    return bits


def can_be_similar(size_a: int, a: bytes | None, size_b: int, b: bytes | None, num: int, den: int) -> bool:
    """Whether two sets can reach the threshold, by their sizes and sketches (no sketch: they can)."""
    if a is None or b is None:
        return True
    cells = 8 * min(len(a), len(b))
    differ = max((folded(a, cells) ^ folded(b, cells)).bit_count(), abs(size_a - size_b))
    both = size_a + size_b
    return (both - differ) * den >= (both + differ) * num


def set_table(docs: DataFrame, n: int) -> DataFrame:
    """(id, n_shingles, d1, sketch) of every row of ``docs`` (``id``, ``text``)."""
    def run(batches):
        for batch in batches:
            size, d1, sketch = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, n)
                size.append(len(s))
                d1.append(set_digest(s)[0])
                sketch.append(odd_sketch(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(sketch, pa.binary())],
                names=["id", "n_shingles", "d1", "sketch"])

    kind = docs.schema["id"].dataType.simpleString()
    return map_arrow(docs.select("id", "text"), run, f"id {kind}, n_shingles long, d1 long, sketch binary")


def signature_table(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(sig, vertex): the signatures of every set, once a task for equal sets in sight."""
    def run(batches):
        bands, seen = Bands(num, den), set()
        for batch in batches:
            sigs, vertex, held = [], [], 0
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, n)
                d = set_digest(s)[0]
                if d in seen:
                    continue
                if len(seen) >= _MAX_SEEN:
                    seen.clear()
                seen.add(d)
                got = signatures(s, bands)
                if len(got):
                    sigs.append(got)
                    vertex.append(np.full(len(got), d, np.int64))
                    held += len(got)
                if held > 200_000:
                    yield _two(sigs, vertex)
                    sigs, vertex, held = [], [], 0
            if held:
                yield _two(sigs, vertex)

    def _two(sigs, vertex):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)),
                                           pa.array(np.concatenate(vertex))], names=["sig", "vertex"])

    return map_arrow(docs.select("text"), run, "sig long, vertex long")


def pivot_pairs(sigs: DataFrame) -> DataFrame:
    """(pivot, vertex, crowded): every member of a bucket with the bucket's smallest vertex, once;
    ``crowded`` where they met in a bucket with a third member, so that there is more to compare."""
    bucket = Window.partitionBy("sig")
    return (sigs.withColumn("pivot", F.min("vertex").over(bucket))
            .withColumn("crowded", F.count(F.lit(1)).over(bucket) > 2).where("pivot <> vertex")
            .groupBy("pivot", "vertex").agg(F.max("crowded").alias("crowded")))


def possible_pairs(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``pairs`` that need their texts: those whose sets can be similar, and members of a crowded bucket
    that can be similar to another member of their pivot. ``sketches``: vertex, size, sketch."""
    def run(batches):
        for batch in batches:
            p, v, crowded, size_p, sk_p, size_v, sk_v = (c.to_pylist() for c in batch.columns)
            can = [can_be_similar(*t, num, den) for t in zip(size_p, sk_p, size_v, sk_v, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(can, pa.bool_()), batch.column(5), batch.column(6)],
                names=["pivot", "vertex", "crowded", "can", "size", "sketch"])

    of_pivot = sketches.select(F.col("vertex").alias("pivot"), F.col("size").alias("size_p"), F.col("sketch").alias("sk_p"))
    rows = (pairs.join(sketches, "vertex", "left").join(of_pivot, "pivot", "left")
            .select("pivot", "vertex", "crowded", "size_p", "sk_p", "size", "sketch"))
    judged = written(map_arrow(rows, run, "pivot long, vertex long, crowded boolean, can boolean, size long, sketch binary"),
                     "judged")
    lone = (judged.where("crowded").groupBy("pivot").agg(F.count(F.lit(1)).alias("m"), F.min("can").alias("all_can"))
            .where("m > 1 and not all_can").select("pivot", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")).checkpoint())
    members = _in_blocks(judged.where("crowded").join(_broadcast_if_few(lone), "pivot"),
                         "vertex", "can", "size", "sketch")

    def flag(pdf: pd.DataFrame) -> pd.DataFrame:
        found = flagged_in_block(pdf, num, den)
        return pd.DataFrame({"pivot": pdf["pivot"].iloc[:1].repeat(len(found)), "vertex": found})

    flagged = (members.groupBy("pivot", "lo", "hi").applyInPandas(flag, "pivot long, vertex long").distinct()
               .withColumn("flagged", F.lit(True)))
    return (judged.select("pivot", "vertex", "crowded", "can").join(flagged, ["pivot", "vertex"], "left")
            .where("can or flagged").select("pivot", "vertex", "crowded"))


def flagged_in_block(pdf: pd.DataFrame, num: int, den: int) -> np.ndarray:
    """Vertices of a block (vertex, can, size, sketch, part) that can be similar to another one of it,
    at least one of the two not to their pivot. Members without a sketch go with any."""
    pdf = pdf.drop_duplicates("vertex").reset_index(drop=True)
    can, part, vertex = (pdf[c].to_numpy() for c in ("can", "part", "vertex"))
    rows = np.flatnonzero(~can.astype(bool))
    known = pdf["sketch"].notna().to_numpy()
    if len(pdf) < 2 or not len(rows):
        return vertex[:0]
    size = pdf["size"].fillna(0).to_numpy().astype(np.int64)
    cells = 8 * min(len(x) for x in pdf["sketch"][known]) if known.any() else 256
    signs = np.stack([np.frombuffer(folded(x, cells).to_bytes(cells // 8, "little") if ok else bytes(cells // 8), np.uint8)
                      for x, ok in zip(pdf["sketch"], known, strict=True)])
    signs = np.unpackbits(signs, axis=1).astype(np.float32) * 2 - 1
    two = len(set(part)) > 1
    hit = np.zeros(len(pdf), bool)
    for a in range(0, len(rows), 256):
        some = rows[a:a + 256]
        differ = ((cells - signs[some] @ signs.T) / 2).round().astype(np.int64)
        differ = np.maximum(differ, np.abs(size[some][:, None] - size[None, :]))
        both = size[some][:, None] + size[None, :]
        near = (both - differ) * den >= (both + differ) * num
        near |= ~known[some][:, None] | ~known[None, :]
        near &= (part[some][:, None] != part[None, :]) if two else (some[:, None] != np.arange(len(pdf))[None, :])
        hit[some] |= near.any(axis=1)
        hit |= near.any(axis=0)
    return vertex[hit]


def _in_blocks(members: DataFrame, *columns: str) -> DataFrame:
    """Members of a pivot (with its number of ``blocks``) dealt into all pairs of its blocks."""
    return (members.withColumn("own", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("pivot", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                    F.col("own").alias("part"), *columns))


def compare_with_pivot(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(pivot, vertex, size, linked, diff): exact comparison of every pair; ``diff`` is the symmetric
    difference of the two sets of a crowded pair, NULL of others."""
    def run(batches):
        recent: OrderedDict[int, np.ndarray] = OrderedDict()
        for batch in batches:
            p, v, crowd, tp, tv = (c.to_pylist() for c in batch.columns)
            size, linked, diff = [], [], []
            for pivot, crowded, text_p, text_v in zip(p, crowd, tp, tv, strict=True):
                if pivot not in recent:
                    recent[pivot] = shingle_set(text_p, n)
                    if len(recent) > 32:
                        recent.popitem(last=False)
                a, b = recent[pivot], shingle_set(text_v, n)
                d = np.setxor1d(a, b, assume_unique=True)
                inter, union = (len(a) + len(b) - len(d)) // 2, (len(a) + len(b) + len(d)) // 2
                size.append(len(b))
                linked.append(inter * den >= union * num)
                diff.append(d.view(np.int64) if crowded else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int64()), pa.array(v, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(linked, pa.bool_()), pa.array(diff, pa.list_(pa.int64()))],
                names=["pivot", "vertex", "size", "linked", "diff"])

    rows = (pairs.join(texts.withColumnRenamed("text", "text_v"), "vertex")
            .join(texts.select(F.col("vertex").alias("pivot"), F.col("text").alias("text_p")), "pivot")
            .select("pivot", "vertex", "crowded", "text_p", "text_v"))
    return map_arrow(rows, run, "pivot long, vertex long, size long, linked boolean, diff array<long>")


def links_in_block(pdf: pd.DataFrame, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a block's members that cross components (column
    ``root``) and that the pivot does not give. Columns vertex, size, linked, diff, root, part;
    only pairs of one member of each part are looked at where there are two parts."""
    pdf = pdf.drop_duplicates("vertex").reset_index(drop=True)
    m = len(pdf)
    size, linked, root = (pdf[c].to_numpy() for c in ("size", "linked", "root"))
    part = pdf["part"].to_numpy()
    diffs = [np.asarray(d, np.int64) for d in pdf["diff"]]
    length = np.array([len(d) for d in diffs], np.int64)
    rows = np.flatnonzero(~linked)
    if m < 2 or not len(rows):
        return []
    owner = np.repeat(np.arange(m), length)
    _, element, times = np.unique(np.concatenate(diffs), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[element]
    owner, element = owner[keep], column[element[keep]]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    overlap = np.zeros((len(rows), m), np.float32)
    n_columns = int(shared.sum())
    for start in range(0, n_columns, 2048):  # the incidence matrix, some columns at a time
        lo, hi = np.searchsorted(element, (start, start + 2048))
        if lo == hi:
            continue
        block = np.zeros((m, min(2048, n_columns - start)), np.float32)
        block[owner[lo:hi], element[lo:hi] - start] = 1
        overlap += block[rows] @ block.T
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    two = len(set(part)) > 1
    out = []
    for i, row in enumerate(rows):
        differ = length[row] + length - 2 * overlap[i].astype(np.int64)
        both = size[row] + size
        hit = ((both - differ) // 2 * den >= (both + differ) // 2 * num) & (root != root[row])
        if two:
            hit &= part != part[row]
        for j in np.flatnonzero(hit):
            a, b = find(int(root[row])), find(int(root[j]))
            if a != b:
                parent[a] = b
                out.append((int(pdf["vertex"][row]), int(pdf["vertex"][j])))
    return out


def links_among_members(stars: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): links between members of one pivot that no chain of pivot links gives yet."""
    stars = stars.where("diff IS NOT NULL")
    sizes = (stars.groupBy("pivot").agg(F.count(F.lit(1)).alias("m"), F.min("linked").alias("all_linked"))
             .where("m > 1 and not all_linked").select("pivot", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
             .checkpoint())
    # beside small tables the differences are shuffled once only, by block
    members = _in_blocks(stars.join(_broadcast_if_few(sizes), "pivot")
                         .join(_broadcast_if_few(roots), stars.vertex == roots.v, "left")
                         .withColumn("root", F.coalesce("root", "vertex")).drop("v"),
                         "vertex", "size", "linked", "diff", "root")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links_in_block(pdf, num, den), columns=["u", "v"], dtype="int64")

    return members.groupBy("pivot", "lo", "hi").applyInPandas(run, "u long, v long")


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 4,
                    num: int = 85, den: int = 100) -> DataFrame:
    """(id_col, n_shingles, component_id) of every row: components of the links between documents
    whose sets of distinct ``n``-word shingles have intersection * den >= union * num.

    A text of fewer words is one shingle; NULL, empty and blank texts have an empty set, are linked
    with nothing and get their own id as component. ``component_id`` is the smallest id reachable,
    the row's own included. Repeated rows are linked like other equal texts; a NULL id is never a
    component's id unless all its rows have none. Other columns are ignored. Hashes have 64 bits;
    links are decided on whole sets.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sets = written(set_table(docs, n), "sets")
    vertices = (sets.where("n_shingles > 0").groupBy(F.col("d1").alias("vertex"))
                .agg(F.min("id").alias("least_id")))
    pairs = written(pivot_pairs(signature_table(docs, n, num, den)), "pairs")
    roots = _roots(docs, sets, vertices, pairs, n, num, den)
    labelled = (vertices.join(roots, vertices.vertex == roots.v, "left")
                .select("vertex", "least_id", F.coalesce("root", "vertex").alias("root")))
    component = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    # two plain tables beside the last join, so that a hot vertex's side can be split
    of_vertex = labelled.join(component, "root").select("vertex", "component_id").checkpoint()
    full = sets.where("n_shingles > 0").join(of_vertex, sets.d1 == of_vertex.vertex)
    empty = sets.where("n_shingles = 0").withColumn("component_id", F.col("id"))
    out = [F.col("id").alias(id_col), "n_shingles", "component_id"]
    return full.select(*out).unionByName(empty.select(*out))


def _broadcast_if_few(small: DataFrame) -> DataFrame:
    """A checkpointed table of a few numbers a row, broadcast when it has at most
    :data:`MAX_BROADCAST_ROWS` rows; a plain table else, beside which a hot key's side can be split."""
    return F.broadcast(small) if small.count() <= MAX_BROADCAST_ROWS else small


def _of_vertex(found: DataFrame, n: int) -> DataFrame:
    """The rows whose text has the set of their vertex (ids may repeat with other texts)."""
    def run(batches):
        for batch in batches:
            vertex, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield batch.filter(pa.array([set_digest(shingle_set(t, n))[0] == v
                                         for v, t in zip(vertex, text, strict=True)], pa.bool_()))

    return map_arrow(found, run, "vertex long, text string")


def _with_vertex(texts: DataFrame, n: int) -> DataFrame:
    """(vertex, text) of every row: for sets that no id leads to."""
    def run(batches):
        for batch in batches:
            vertex = [set_digest(shingle_set(t, n))[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(vertex, pa.int64()), batch.column(0)], names=["vertex", "text"])

    return map_arrow(texts, run, "vertex long, text string")


def _wanted(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(vertex, id) of every end of a pair, with the smallest id of its rows."""
    ends = pairs.select(F.explode(F.array("pivot", "vertex")).alias("vertex")).distinct()
    return vertices.join(ends, "vertex").select("vertex", F.col("least_id").alias("id")).checkpoint()


def _roots(docs: DataFrame, sets: DataFrame, vertices: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    # sketches are fetched by id as well as by digest: one row for each vertex, however many have its set
    named = _wanted(vertices, pairs).where("id IS NOT NULL").withColumnsRenamed({"id": "of_id"})
    sketches = (sets.join(_broadcast_if_few(named), (sets.id == named.of_id) & (sets.d1 == named.vertex))
                .select("vertex", F.col("n_shingles").alias("size"), "sketch").dropDuplicates(["vertex"]))
    pairs = written(possible_pairs(pairs, written(sketches, "sketches"), num, den), "possible")
    wanted = _wanted(vertices, pairs)
    found = _of_vertex(docs.join(_broadcast_if_few(wanted), "id").select("vertex", "text"), n)
    nameless = wanted.where("id IS NULL").select("vertex").checkpoint()
    if not nameless.isEmpty():
        own = _with_vertex(docs.where("id IS NULL").select("text"), n)
        found = found.unionByName(own.join(_broadcast_if_few(nameless), "vertex").select("vertex", "text"))
    texts = written(found.dropDuplicates(["vertex"]), "texts")
    stars = written(compare_with_pivot(pairs, texts, n, num, den), "stars")
    sure = stars.where("linked").select(F.col("pivot").alias("u"), F.col("vertex").alias("v"))
    first = connected_components(sure).checkpoint()
    more = written(links_among_members(stars, first, num, den), "links")
    if more.isEmpty():
        return first
    return connected_components(more.unionByName(first.select(F.col("v").alias("u"), F.col("root").alias("v"))))
