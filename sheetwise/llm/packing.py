"""Packing of documents into token sequences: first-fit decreasing with a tournament tree.

Documents are encoded once and written with their ids. Only lengths and checksums are packed: rows
are dealt into randomised groups of bounded size, every group on its own. In a group, the parts of
documents that fill a sequence alone are set aside; the remainders go, longest first, into the first
sequence with room, which a tournament tree over the free room of all sequences finds in
``log2(sequences)`` steps. What room is left then is filled by cutting pieces of the emptiest
sequences, and the last open sequence is cut into powers of two, so no sequence needs padding.

Checksums of whole pieces come from the encoding pass; ids are read again only for documents that
the last step cut.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sheetwise.llm.bpe_tables import _BLOCKS, _needs_library, byte_symbols
from sheetwise.llm.common import MAX_BROADCAST_IDS, ROWS_AT_ONCE, map_arrow, map_column, written

CAPACITY = 4096
END_ID = 2
#: A group has about so many rows and at most about so many pieces: what one task packs at a time.
GROUP_ROWS = 20_000
GROUP_PIECES = 100_000
#: Words a worker remembers the ids of (in two generations); results do not depend on it.
MAX_WORDS = 500_000
_LONG = 64

#: Fixed value: the split pattern of the lower-case vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# the same for characters that `re` classes alike (see bpe_tables)
_FAST = re.compile(r"[^\W\d_]+|\d|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|_)+").findall

_SYMBOLS = byte_symbols()

PIECES = ("row_key long, doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, `offset` long")


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class IdEncoder:
    """Ids of whole texts exactly as the tokenizer library gives them, without added special tokens.

    Texts in common scripts are split into words here; the library's model encodes every new word
    once, and a table remembers it. Any other text, and one that holds a special string, is encoded
    by the library as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self._by_word = (steps == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split"
                         and split.get("pattern") == {"Regex": WORD_PATTERN}
                         and split.get("behavior") == "Removed" and split.get("invert") is True)
        self._strings = [t["content"] for t in spec.get("added_tokens") or []]
        # characters of common scripts that `re` and the library class alike and whose lower case
        # Python and the library see alike (that of capital sigma depends on the context)
        lower = self.tokenizer.normalizer.normalize_str if self._by_word else str
        plain = [c for b in _BLOCKS for c in map(chr, b) if c != "Σ" and _needs_library()(c) is None
                 and (c.isspace() or len(c.lower()) == 1 and lower(c) == unicodedata.normalize("NFC", c).lower())]
        self._odd = re.compile("[^" + "".join(map(re.escape, plain)) + "]").search
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """The ids of one lower-case word: the merges of its bytes' symbols."""
        symbols = word if word.isascii() and word.isprintable() else "".join(map(_SYMBOLS.__getitem__, word.encode()))
        return packed([t.id for t in self.tokenizer.model.tokenize(symbols)])

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if not self._by_word or self._odd(text) or any(s in text for s in self._strings) \
                or not unicodedata.is_normalized("NFC", text):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = _FAST(text.lower())
        new = set(words).difference(self._known)
        if new:
            ids = {w: self._older[w] if w in self._older else self._word(w) for w in new}
            if len(self._known) + len(new) > MAX_WORDS:
                self._older, self._known = self._known, {w: self._known[w] for w in set(words).difference(new)}
            self._known.update(ids)
        out = b"".join(map(self._known.__getitem__, words))
        for word in new:
            if len(word) > _LONG:  # not worth remembering
                del self._known[word]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> IdEncoder:
    """One encoder a worker process and vocabulary file."""
    return IdEncoder(path)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Every row of ``df`` (equal rows and rows without an id too) as ``row_key`` (unique), ``doc_id``,
    ``ids`` (whole text, then ``end_id``; little-endian 32-bit), ``n_tokens`` and ``crcs`` (of
    every ``capacity`` ids and of the rest). A NULL or empty text has the end id alone. Written to
    the shared folder, so keys stay what they are."""
    end = packed([end_id])

    def run(texts: pa.Array) -> list[pa.Array]:
        coded = [encoder(path).encode(t) + end for t in texts.to_pylist()]
        return [pa.array(coded, pa.binary()), pa.array([len(c) // 4 for c in coded], pa.int64()),
                pa.array([[zlib.crc32(c[i:i + 4 * capacity]) for i in range(0, len(c), 4 * capacity)]
                          for c in coded], pa.list_(pa.int64()))]

    rows = df.select(F.monotonically_increasing_id().alias("row_key"), F.col(f"`{id_col}`").alias("doc_id"),
                     F.col(f"`{text_col}`").alias("text"))
    return written(map_column(rows, "text", run, ("ids", T.BinaryType()), ("n_tokens", T.LongType()),
                              ("crcs", T.ArrayType(T.LongType())), drop_source=True), "encoded")


def first_fit(lengths: list[int], capacity: int = CAPACITY) -> list[int]:
    """The bin of every length (given longest first): the first bin with room for it. Bins are the
    leaves of a tournament tree whose inner nodes hold the most room below them."""
    size = 1
    while size < len(lengths):
        size *= 2
    room = [capacity] * (2 * size)
    out = []
    for need in lengths:
        node = 1
        while node < size:
            node *= 2
            if room[node] < need:
                node += 1
        out.append(node - size)
        room[node] -= need
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return out


def fill_up(bins: list[list[tuple[int, int, int]]], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """``bins`` of pieces (item, start, length) without padding: the fullest open bins take pieces,
    cut where need be, from the emptiest ones; the last is cut into bins of powers of two."""
    fill = [sum(p[2] for p in b) for b in bins]
    whole = [b for b, n in zip(bins, fill, strict=True) if n == capacity]
    open_ = sorted((i for i, n in enumerate(fill) if n < capacity), key=lambda i: (-fill[i], i))
    to, frm = 0, len(open_) - 1
    while to < frm:
        taker, giver = bins[open_[to]], bins[open_[frm]]
        gap = capacity - fill[open_[to]]
        item, start, length = giver.pop()
        taken = min(gap, length)
        taker.append((item, start, taken))
        if taken < length:
            giver.append((item, start + taken, length - taken))
        fill[open_[to]] += taken
        fill[open_[frm]] -= taken
        if fill[open_[to]] == capacity:
            whole.append(taker)
            to += 1
        if not giver:
            frm -= 1
    if to == frm and fill[open_[to]]:
        pieces, left = bins[open_[to]], fill[open_[to]]
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            part = []
            while want:
                item, start, length = pieces.pop(0)
                taken = min(want, length)
                part.append((item, start, taken))
                if taken < length:
                    pieces.insert(0, (item, start + taken, length - taken))
                want -= taken
            whole.append(part)
    return whole


def pack_group(keys: list[int], tokens: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (place in ``keys``, start, length) of one group; ties go by key."""
    out = [[(i, s, capacity)] for i, n in enumerate(tokens) for s in range(0, n - n % capacity, capacity)]
    rest = sorted((i for i, n in enumerate(tokens) if n % capacity), key=lambda i: (-(tokens[i] % capacity), keys[i]))
    lengths = [tokens[i] % capacity for i in rest]
    bins: list[list[tuple[int, int, int]]] = []
    for i, length, b in zip(rest, lengths, first_fit(lengths, capacity), strict=True):
        if b == len(bins):
            bins.append([])
        bins[b].append((i, tokens[i] - length, length))
    return out + fill_up(bins, capacity)


def pack(encoded: DataFrame, capacity: int = CAPACITY, seed: int = 1, group_rows: int = GROUP_ROWS,
         group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces of all rows of ``encoded`` (see :func:`encode_documents`): ``row_key``, ``doc_id``,
    ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset`` (place in
    the sequence). Every id lies in exactly one piece; sequences are of ``capacity`` ids (a power of
    two) or, fewer than its bits in each group, of smaller powers of two. Which rows meet in a group is decided
    by a hash of their key and ``seed``. No rows: no pieces."""
    sizes = encoded.agg(F.count(F.lit(1)).alias("n"), F.sum(F.ceil(F.col("n_tokens") / capacity)).alias("p")).first()
    groups = max(1, -(-sizes.n // group_rows), -(-int(sizes.p or 0) // group_pieces))
    rows = encoded.select("row_key", "doc_id", "n_tokens", "crcs",
                          F.pmod(F.xxhash64("row_key", F.lit(seed)), F.lit(groups)).alias("group"))
    schema = T._parse_datatype_string(PIECES.format(id=encoded.schema["doc_id"].dataType.simpleString()))
    ids = "doc_id"

    def run(table: pa.Table) -> pa.Table:
        group = table["group"][0].as_py()
        keys, tokens, crcs = (table[c].to_pylist() for c in ("row_key", "n_tokens", "crcs"))
        at, start, length, crc, seq, offset = [], [], [], [], [], []
        for s, pieces in enumerate(pack_group(keys, tokens, capacity)):
            place = 0
            for i, a, n in pieces:
                at.append(i)
                start.append(a)
                length.append(n)
                # known for pieces that begin at a multiple of the capacity and run to the next or the end
                known = a % capacity == 0 and (n == capacity or a + n == tokens[i])
                crc.append(crcs[i][a // capacity] if known else None)
                seq.append(group << 32 | s)
                offset.append(place)
                place += n
        return pa.table({
            "row_key": pa.array([keys[i] for i in at], pa.int64()), "doc_id": table[ids].take(pa.array(at, pa.int64())),
            "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
            "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array([tokens[i] for i in at], pa.int64()),
            "sequence_id": pa.array(seq, pa.int64()), "offset": pa.array(offset, pa.int64())})

    pieces = written(rows.groupBy("group").applyInArrow(run, schema), "pieces")
    return pieces.where("ids_crc32 IS NOT NULL").unionByName(_with_crc(pieces.where("ids_crc32 IS NULL"), encoded))


def _with_crc(cut: DataFrame, encoded: DataFrame) -> DataFrame:
    """Pieces of cut documents with the checksums of their ids: the documents' keys are broadcast up to
    :data:`MAX_BROADCAST_IDS`, else joined by a shuffle. A document has at most ``capacity`` cuts."""
    mine = (cut.groupBy("row_key").agg(F.collect_list(F.struct(*cut.columns)).alias("pieces"))
            .withColumnRenamed("row_key", "cut_key").checkpoint())
    few = mine.count() <= MAX_BROADCAST_IDS
    rows = (encoded.select("row_key", "ids").join(F.broadcast(mine) if few else mine, F.col("row_key") == F.col("cut_key"))
            .select("ids", "pieces"))
    names = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(begin, ROWS_AT_ONCE)
                flat = pa.RecordBatch.from_struct_array(batch.column(1).flatten())
                data, crc, k = batch.column(0), [], 0
                starts, lengths = flat["start"].to_pylist(), flat["length"].to_pylist()
                for i, n in enumerate(batch.column(1).value_lengths().to_pylist()):
                    ids = memoryview(data[i].as_buffer())
                    for _ in range(n):
                        crc.append(zlib.crc32(ids[4 * starts[k]:4 * (starts[k] + lengths[k])]))
                        k += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(crc, pa.int64()) if c == "ids_crc32" else flat[c] for c in names], names=names)

    return map_arrow(rows, run, cut.schema)


def sequences(pieces: DataFrame, encoded: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``n_tokens``, ``ids`` (little-endian 32-bit)
    and ``pieces`` (offset, row_key, doc_id, start, length) in order. A sequence is bounded by the capacity."""
    part = F.substring("ids", (4 * F.col("start") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    rows = pieces.join(encoded.select("row_key", "ids"), "row_key").withColumn("part", part)
    entry = F.struct("offset", "row_key", "doc_id", "start", "length", "part")
    whole = rows.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"),
                                            F.array_sort(F.collect_list(entry)).alias("all"))
    return whole.select(
        "sequence_id", "n_tokens",
        F.aggregate("all", F.lit(b""), lambda acc, p: F.concat(acc, p["part"])).alias("ids"),
        F.transform("all", lambda p: p.dropFields("part")).alias("pieces"))
