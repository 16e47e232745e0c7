"""Benchmark decontamination: SimHash fingerprints of item-sized windows, a multi-index over
Hamming blocks, and exact weighted-shingle similarity of the candidates.

**Window sizes.** An item of ``n`` words is sought by windows of one size class: the largest class
not above the run of unchanged words that any passage of sufficient similarity must still share
with the item (:func:`clean_run`), nor above the shortest text that can be so similar
(:func:`shortest_text`). A window of that size inside the run has the very fingerprint
of one of the item's own windows, so edits elsewhere cannot hide the item; fingerprints within
``RADIUS`` bits are candidates too.

**Search.** A 64-bit fingerprint is cut into ``RADIUS + 1`` blocks; two fingerprints within the
radius agree on a block. Each class has one index a block: block value -> the items' windows.
Every window of every size class of every whole document is looked up.

**Verification.** A candidate aligns the item in the document; item-sized windows around that place
are compared exactly by weighted Jaccard similarity of their word shingles (weight: occurrences).

The benchmark is read in blocks of bounded size, each one pass over the documents; it is never
joined with them.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from sheetwise.llm.common import ROWS_AT_ONCE, map_arrow
from sheetwise.llm.shingles import shingles, word_hashes

SHINGLE = 5
#: Similarity reached by 4 / 5 or more.
NUM, DEN = 4, 5
RADIUS = 3
_BLOCKS = 4  # of 16 bits: more than the radius
#: Benchmark text that one pass over the documents holds (bytes).
BLOCK_BYTES = 32 << 20
#: Window starts fingerprinted together.
_ROWS = 1 << 12


def clean_run(n: int) -> int:
    """The words in a row, of an item of ``n`` words, that every text window of the same size and
    similarity ``NUM / DEN`` has unchanged. Of s shingles at most s * (DEN - NUM) / (DEN + NUM) may
    be lost; an edit inside loses ``SHINGLE`` of them, one at the edge fewer."""
    s = max(1, n - SHINGLE + 1)
    lost = s * (DEN - NUM) // (DEN + NUM)
    inside = lost // (SHINGLE - 1)  # a deleted word loses one shingle fewer than a replaced one
    return max(1, min((n - lost - inside) // (inside + 1), n - lost)) if inside else max(1, n - lost)


def shortest_text(n: int) -> int:
    """The words of the shortest text whose similarity to an item of ``n`` words can reach ``NUM / DEN``."""
    s = max(1, n - SHINGLE + 1)
    return min(n, -(-s * NUM // DEN) + SHINGLE - 1)


def size_classes(longest: int) -> list[int]:
    """Window sizes in words: every size up to the shingle's, then steps of about a third."""
    out = list(range(1, SHINGLE + 1))
    while out[-1] < longest:
        out.append(max(out[-1] + 1, out[-1] * 4 // 3))
    return out


def fingerprints(sh: np.ndarray, widths: list[int]) -> dict[int, np.ndarray]:
    """For each of ``widths``, the SimHash of every run of so many shingles: bit b is set where more
    than half of them have it set. Bits are summed over runs of 1, 2, 4, ... shingles once, and a
    width is put together from those."""
    out: dict[int, list[np.ndarray]] = {w: [] for w in widths}
    most = max(widths, default=1)
    kind = np.uint8 if most < 256 else np.uint32
    for a in range(0, len(sh), _ROWS):
        here = min(_ROWS, len(sh) - a)
        part = sh[a:a + here + most - 1]
        sums = [np.unpackbits(part.view(np.uint8)).reshape(-1, 64).astype(kind, copy=False)]
        for w in widths:
            n = min(here, len(part) - w + 1)
            if n <= 0:
                continue
            if w == 1:
                out[w].append(part[:n])
                continue
            total, at = None, 0
            for j in range(w.bit_length()):
                if len(sums) == j:
                    half = 1 << (j - 1)
                    sums.append(sums[-1][:-half] + sums[-1][half:])
                if w >> j & 1:
                    piece = sums[j][at:at + n]
                    total = piece if total is None else total + piece
                    at += 1 << j
            out[w].append(np.packbits(total > w // 2).view(np.uint64))
    return {w: np.concatenate(v) if v else np.zeros(0, np.uint64) for w, v in out.items()}


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: sum of the smaller weights over the sum of the larger ones."""
    low = sum(min(w, b[s]) for s, w in a.items())
    return low / (sum(a.values()) + sum(b.values()) - low)


class _SizeClass:
    def __init__(self, words: int):
        self.width = max(1, words - SHINGLE + 1)
        self.shingle = min(words, SHINGLE)
        self._prints: list[np.ndarray] = []
        self._where: list[tuple[int, int]] = []

    def add(self, item: int, hashes: np.ndarray) -> None:
        fp = fingerprints(shingles(hashes, self.shingle), [self.width])[self.width]
        self._prints.append(fp)
        self._where += [(item, k) for k in range(len(fp))]

    def build(self) -> None:
        self.prints = np.concatenate(self._prints)
        self.where = self._where
        del self._prints, self._where
        self.index = []  # of each block: used values, their first place and number, windows by value
        for b in range(_BLOCKS):
            value = _blocks(self.prints)[:, b]
            number = np.bincount(value, minlength=1 << 16)
            self.index.append((number > 0, np.cumsum(number) - number, number,
                               np.argsort(value, kind="stable")))

    def candidates(self, fp: np.ndarray):
        """(place in the document, item, place in the item) of fingerprints within the radius."""
        values = _blocks(fp)
        for b, (used, first, number, order) in enumerate(self.index):
            at = np.flatnonzero(used.take(values[:, b]))
            if not len(at):
                continue
            v = values[at, b]
            mates = number[v]
            step = np.arange(int(mates.sum())) - np.repeat(np.cumsum(mates) - mates, mates)
            window = order[np.repeat(first[v], mates) + step]
            at = np.repeat(at, mates)
            near = np.bitwise_count(self.prints[window] ^ fp[at]) <= RADIUS
            for place, i in zip(at[near].tolist(), window[near].tolist(), strict=True):
                yield place, *self.where[i]


def _blocks(fp: np.ndarray) -> np.ndarray:
    """[fingerprints, blocks]: the 16-bit blocks of each fingerprint."""
    return fp.view(np.uint16).reshape(-1, _BLOCKS)


class BenchmarkIndex:
    """The items of one block of the benchmark, indexed by size class."""

    def __init__(self, items: list[tuple]):
        hashed = [(i, word_hashes(t)) for i, t in items]
        self.items = [(i, h) for i, h in hashed if len(h)]
        self._weights = [Counter(shingles(h, SHINGLE).tolist()) for _, h in self.items]
        sizes = size_classes(max((len(h) for _, h in self.items), default=1))
        self.classes: dict[int, _SizeClass] = {}
        for k, (_, h) in enumerate(self.items):
            words = max(s for s in sizes if s <= min(clean_run(len(h)), shortest_text(len(h))))
            self.classes.setdefault(words, _SizeClass(words)).add(k, h)
        self._by_shingle: dict[int, list[_SizeClass]] = defaultdict(list)
        for c in self.classes.values():
            c.build()
            self._by_shingle[c.shingle].append(c)

    def search(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text (item id, similarity, first word, words) of the best window of every item
        that some window of the text reaches. Fingerprints of all the texts are looked up together."""
        hashed = [word_hashes(t) for t in texts]
        starts: list[dict[int, set[int]]] = [defaultdict(set) for _ in texts]
        for k, sized in self._by_shingle.items():
            long = [i for i, h in enumerate(hashed) if len(h) >= k]
            prints = [fingerprints(shingles(hashed[i], k), [c.width for c in sized]) for i in long]
            for c in sized:
                ends = np.cumsum([len(p[c.width]) for p in prints])
                if not len(ends) or not ends[-1]:
                    continue
                owner = np.repeat(np.arange(len(long)), np.diff(ends, prepend=0))
                begin = ends - np.diff(ends, prepend=0)
                for at, item, offset in c.candidates(np.concatenate([p[c.width] for p in prints])):
                    o = owner[at]
                    starts[long[o]][item].add(int(at - begin[o]) - offset)
        out = []
        for h, places in zip(hashed, starts, strict=True):
            best = ((item, self._best(item, h, where)) for item, where in places.items())
            out.append([(self.items[item][0], *b) for item, b in best if b])
        return out

    def _best(self, item: int, h: np.ndarray, places: set[int]):
        n = len(self.items[item][1])
        slack = 1 + n * (DEN - NUM) // (DEN + NUM)
        last = max(0, len(h) - n)
        tried = {min(max(p + d, 0), last) for p in places for d in range(-slack, slack + 1)}
        best = None
        for start in sorted(tried):
            window = h[start:start + n]
            got = similarity(self._weights[item], Counter(shingles(window, SHINGLE).tolist()))
            if got * DEN >= NUM and (best is None or got > best[0]):
                best = (got, start, len(window))
        return best


_LOADED: dict[str, BenchmarkIndex] = {}


def find_contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                       item_text_col: str = "text", item_id_col: str = "item_id") -> DataFrame:
    """(id_col, item_id, similarity, first_word, n_words): for every row and every benchmark item,
    the best window of as many words as the item has whose weighted similarity on five-word shingles
    is 0.8 or more (of ties the first). Shorter items are one shingle; a text shorter than the item
    is compared whole.

    NULL, empty and blank texts and items match nothing; repeated rows and items are each reported;
    an empty table on either side gives an empty result; other columns are ignored.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = (benchmark.select(F.col(f"`{item_id_col}`").alias("item_id"),
                              F.col(f"`{item_text_col}`").cast("string").alias("text"))
             .where(F.col("text").isNotNull()))
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (items, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, first_word int, n_words int"
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-n_bytes // BLOCK_BYTES)
    found = df.sparkSession.createDataFrame([], schema)
    for b in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b)
        found = found.unionByName(_search(docs, [tuple(r) for r in block.collect()], schema))
    return found.select(F.col("doc_id").alias(id_col), *found.columns[1:])


def _search(docs: DataFrame, items: list[tuple], schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    key = uuid.uuid4().hex
    item_kind = to_arrow_type(_parse_datatype_string(schema)["item_id"].dataType)

    def run(batches):
        if key not in _LOADED:
            while len(_LOADED) > 3:
                _LOADED.pop(next(iter(_LOADED)))
            _LOADED[key] = BenchmarkIndex(shared.value)
        index = _LOADED[key]
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                hits = [(i, *hit) for i, row in enumerate(index.search(batch.column(1).to_pylist()))
                        for hit in row]
                rows, item, similar, first, n = zip(*hits, strict=True) if hits else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(item, item_kind),
                     pa.array(similar, pa.float64()), pa.array(first, pa.int32()), pa.array(n, pa.int32())],
                    names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return map_arrow(docs, run, schema)
