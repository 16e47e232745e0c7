"""Phrase collocations by the stripes pattern, level by level.

A *stripe* is the associative counter of the words that follow a prefix: prefix -> {next word:
count}. Tasks count their texts into stripes of all prefixes of one length, in bounded chunks; equal
stripes meet in the shuffle and are merged elementwise. The merged structure holds everything:
an entry is the frequency of an extension (prefix plus next word), the entry of a prefix's own last
word is that prefix's total, the root stripe's sum is the number of words, and the largest entry of a
stripe, from either side, decides whether a phrase is subsumed by a longer one (a longer phrase never
occurs more often than the one-word extension inside it, so one word more on either side suffices).

Stripes of longer prefixes are only counted where every shorter part can be frequent: the frequent
phrases of a level are handed to the next as a bitmap of fixed greatest size. A false positive of the bitmap costs
a counter that the threshold drops; no phrase is lost and counts stay exact.

A wide stripe is cut by the hash of the next word, so none is merged in one task: the root stripe
(the vocabulary) into :data:`ROOT_CUTS` parts, and stripes whose prefix has only words of more than a
:data:`HOT_SHARE`-th of all occurrences (so at most that many words) into :data:`HOT_CUTS`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import ROWS_AT_ONCE, map_arrow, written
from sheetwise.llm.shingles import mix

MIN_COUNT = 30
TOP = 2000
UNKNOWN_LANG = "und"
#: Words counted at a time in a worker.
CHUNK_WORDS = 3_000_000
#: Code points split at a time (pieces of the text are never cut).
CHUNK_TEXT = 1 << 20
ROOT_CUTS = 1024
HOT_CUTS = 64
HOT_SHARE = 1000
RANK_CUTS = 32
#: Bits of a bitmap for every frequent phrase, and at most (32 MB).
BITS_PER_PHRASE = 32
MAX_BITS = 1 << 28

# capital letters A-Z are lowered before; every delimiter is a token that ends a piece
_TOKENS = re.compile(r"[^ \t.,;:!?\n-\r]+|[.,;:!?\n-\r]").findall
_DELIMITER = re.compile(r"[.,;:!?\n-\r]")
_DELIMITERS = ".,;:!?\n\x0b\x0c\r"
STRIPES = "lang string, prefix string, cut int, nexts array<string>, counts array<long>"


def _hashes(words: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join([hashlib.blake2b(w.encode(), digest_size=8).digest() for w in words]), np.uint64)


def _then(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of phrases followed by a word."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + right)


class _Ids(dict):
    """word -> id, of one language; ids of all languages come from one list."""

    def __init__(self, words: list[str], langs: list[int], lang: int):
        super().__init__({d: 0 for d in _DELIMITERS})
        self._words, self._langs, self._lang = words, langs, lang

    def __missing__(self, word: str) -> int:
        self._words.append(word)
        self._langs.append(self._lang)
        got = self[word] = len(self._words) - 1
        return got


class _Chunk:
    """Word ids of some texts, 0 after every piece."""

    def __init__(self):
        self.words, self.langs, self.lang_names = [""], [0], []
        self._ids: dict[str, _Ids] = {}
        self._parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: str) -> None:
        ids = self._ids.get(lang)
        if ids is None:
            ids = self._ids[lang] = _Ids(self.words, self.langs, len(self.lang_names))
            self.lang_names.append(lang)
        at = 0
        while at < len(text):
            end = _DELIMITER.search(text, at + CHUNK_TEXT) if len(text) - at > CHUNK_TEXT else None
            end = end.end() if end else len(text)
            tokens = _TOKENS(text, at, end)
            self._parts.append(np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens)))
            self.size += len(tokens)
            at = end
        self._parts.append(np.zeros(1, np.int64))

    def stream(self) -> np.ndarray:
        return np.concatenate(self._parts)


class _Bitmap:
    def __init__(self, bits: np.ndarray):
        self._bits, self._mask = bits, np.uint64(len(bits) * 64 - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        p = h & self._mask
        return (self._bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1


def _rows(chunk: _Chunk, lang: np.ndarray, prefix: pa.Array, cut: np.ndarray, nexts: pa.Array,
          counts: np.ndarray, stripe: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stripes from entries (``cut``, ``nexts``, ``counts`` and the number of their ``stripe``);
    ``lang`` and ``prefix`` are those of every stripe."""
    order = np.lexsort((cut, stripe))
    s, c = stripe[order], cut[order]
    first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])]) if len(s) else np.zeros(0, np.int64)
    ends = np.r_[first, len(s)].astype(np.int32)
    nexts, counts = nexts.take(pa.array(order)), counts[order]
    names = pa.array(chunk.lang_names, pa.string())
    step = 20_000  # stripes a batch
    for a in range(0, len(first), step):
        at = first[a:a + step]
        lo, hi = ends[a], ends[min(a + step, len(first))]
        offsets = pa.array(ends[a:a + len(at) + 1] - lo, pa.int32())
        yield pa.RecordBatch.from_arrays([
            names.take(pa.array(lang[s[at]])), prefix.take(pa.array(s[at])), pa.array(c[at].astype(np.int32)),
            pa.ListArray.from_arrays(offsets, nexts.slice(lo, hi - lo)),
            pa.ListArray.from_arrays(offsets, pa.array(counts[lo:hi].astype(np.int64)))],
            names=["lang", "prefix", "cut", "nexts", "counts"])


def _count(chunk: _Chunk, level: int, frequent: _Bitmap | None, hot: set[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """The stripes of one chunk: level 1 those of the root, 2 of single words, 3 of two words (their
    entries are the next word and the next two)."""
    a = chunk.stream()
    words = pa.array(chunk.words, pa.string())
    langs = np.array(chunk.langs, np.int64)
    hashes = _hashes(chunk.words)
    v = len(chunk.words)
    if level == 1:
        counts = np.bincount(a, minlength=v)
        ids = np.flatnonzero(counts[1:]) + 1
        root = pa.array([""] * max(1, len(chunk.lang_names)), pa.string())
        yield from _rows(chunk, np.arange(len(chunk.lang_names)), root,
                         (hashes[ids] % np.uint64(ROOT_CUTS)).astype(np.int64), words.take(pa.array(ids)),
                         counts[ids], langs[ids])
        return
    is_hot = np.fromiter(((chunk.lang_names[g], w) in hot if hot and w else False
                          for g, w in zip(chunk.langs, chunk.words, strict=True)), bool, v)
    cuts = (hashes % np.uint64(HOT_CUTS)).astype(np.int64)
    if chunk.lang_names:
        hashes = mix(hashes + _hashes(chunk.lang_names)[langs])
    if level == 2:
        ok = frequent.has(hashes)
        ok[0] = False
        at = np.flatnonzero(ok[a[:-1]] & ok[a[1:]])
        key, counts = np.unique(a[at] * v + a[at + 1], return_counts=True)
        left, right = key // v, key % v
        ids, stripe = np.unique(left, return_inverse=True)
        yield from _rows(chunk, langs[ids], words.take(pa.array(ids)), np.where(is_hot[left], cuts[right], 0),
                         words.take(pa.array(right)), counts, stripe)
        return
    # level 3: bigrams that can be frequent, then runs of two and of three of them
    inside = (a[:-1] > 0) & (a[1:] > 0)
    two = np.zeros(len(a), bool)
    two[:-1][inside] = frequent.has(_then(hashes[a[:-1][inside]], hashes[a[1:][inside]]))
    at = np.flatnonzero(two[:-1] & two[1:]) if len(a) > 1 else np.zeros(0, np.int64)
    pair, known = np.unique(a[at] * v + a[at + 1], return_inverse=True)  # known: the prefix at every place
    first, heat = pair // v, is_hot[pair // v] & is_hot[pair % v]
    prefix = pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pa.array(pair % v)), " ")
    three, inverse, counts3 = np.unique(known * v + a[at + 2], return_inverse=True, return_counts=True)
    more = two[at + 2]
    four, counts4 = np.unique(inverse[more] * v + a[at[more] + 3], return_counts=True)
    # entries of a stripe: its next word, and its next two
    stripe, third = three // v, three % v
    longer, fourth = four // v, four % v
    nexts = words.take(pa.array(np.r_[third, third[longer]]))
    tails = words.take(pa.array(fourth))
    nexts = pa.concat_arrays([nexts.slice(0, len(three)),
                              pc.binary_join_element_wise(nexts.slice(len(three)), tails, " ")])
    stripes = np.r_[stripe, stripe[longer]]
    yield from _rows(chunk, langs[first], prefix, np.where(heat[stripes], cuts[np.r_[third, third[longer]]], 0),
                     nexts, np.r_[counts3, counts4], stripes)


def _stripes(texts: DataFrame, level: int, frequent=None, hot: set[tuple[str, str]] = frozenset()) -> DataFrame:
    """The stripes of ``texts`` (lang, text), merged elementwise: lang, prefix, next, f."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = _Bitmap(frequent.value) if frequent is not None else None
        chunk = _Chunk()
        for whole in batches:
            for begin in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(begin, ROWS_AT_ONCE)
                for lang, text in zip(batch.column(0).to_pylist(), pc.ascii_lower(batch.column(1)).to_pylist(), strict=True):
                    chunk.add(lang, text)
                    if chunk.size >= CHUNK_WORDS:
                        yield from _count(chunk, level, bitmap, hot)
                        chunk = _Chunk()
        if chunk.size:
            yield from _count(chunk, level, bitmap, hot)
        pa.default_memory_pool().release_unused()

    return (map_arrow(texts, run, STRIPES)
            .repartition("lang", "prefix", "cut")
            .select("lang", "prefix", "cut", F.explode(F.arrays_zip("nexts", "counts")).alias("e"))
            .groupBy("lang", "prefix", "cut", F.col("e.nexts").alias("next")).agg(F.sum("e.counts").alias("f"))
            .drop("cut"))


def _bitmap(phrases: DataFrame):
    """A broadcast bitmap of the phrases (lang, prefix, next): 32 bits a phrase up to 32 MB."""
    spark = phrases.sparkSession
    n_bits = min(MAX_BITS, 1 << max(16, (phrases.count() * BITS_PER_PHRASE - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, prefix, word = (batch.column(i).to_pylist() for i in range(3))
            tags = _hashes(lang)
            h = mix(_hashes(word) + tags)
            before = np.array([p != "" for p in prefix], bool)
            if before.any():
                h = np.where(before, _then(mix(_hashes(prefix) + tags), h), h)
            p = h & np.uint64(n_bits - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array((p >> np.uint64(6)).astype(np.int64)),
                 pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], names=["word", "mask"])

    found = (map_arrow(phrases.select("lang", "prefix", "next"), run, "word long, mask long")
             .groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow())
    bits = np.zeros(n_bits // 64, np.uint64)
    bits[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bits)


def phrase_counts(df: DataFrame, min_count: int = MIN_COUNT, text_col: str = "text",
                  lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Exact frequencies of all phrases of 1 to 4 words that occur ``min_count`` times or more: ``lang``,
    ``phrase``, ``n_words``, ``f``; and the number of words of every language: ``lang``, ``n``."""
    texts = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"),
                      F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    enough = F.col("f") >= min_count
    root = written(_stripes(texts, 1), "stripes1")
    totals = root.groupBy("lang").agg(F.sum("f").alias("n"))
    words = root.where(enough)
    least = root.agg(F.sum("f")).first()[0] or 0
    hot = {(r.lang, r.next) for r in root.where(F.col("f") > least / HOT_SHARE).collect()}  # under HOT_SHARE rows
    one = _bitmap(words)
    pairs = written(_stripes(texts, 2, one, hot).where(enough), "stripes2")
    two = _bitmap(pairs)
    longer = written(_stripes(texts, 3, two, hot).where(enough), "stripes3")
    phrase = F.concat_ws(" ", "prefix", "next")
    found = words.select("lang", F.col("next").alias("phrase"), F.lit(1).alias("n_words"), "f")
    for level in (pairs, longer):
        found = found.unionByName(level.select("lang", phrase.alias("phrase"),
                                               F.size(F.split(phrase, " ")).alias("n_words"), "f"))
    return found, totals


def collocations(df: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, text_col: str = "text",
                 lang_col: str = "lang") -> DataFrame:
    """The ``top`` phrases of every language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``,
    ``n``, ``score``.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces and at spaces and tabs into words.
    Candidates are phrases of 2 to 4 words with ``a >= min_count`` occurrences within pieces; the
    cut into a first and a second part with the lowest score ``floor(2000000 a / (l + r))`` counts,
    of equal ones the first. Candidates inside a longer one with four fifths of their occurrences are dropped. Ties in
    score and ``a`` go by the phrase's bytes. A NULL text is empty, a NULL language ``und``; repeated
    rows count each; no candidates: no rows. Other columns are ignored."""
    found, totals = phrase_counts(df, min_count, text_col, lang_col)
    candidates = found.where("n_words > 1")
    parts = [F.when(F.col("n_words") > k, F.struct(
        F.lit(k).alias("k"), F.substring_index("phrase", " ", k).alias("left"),
        F.expr(f"substring_index(phrase, ' ', {k} - n_words)").alias("right"))) for k in (1, 2, 3)]
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"),
                             F.explode(F.filter(F.array(*parts), lambda c: c.isNotNull())).alias("cut"))
    l, r = (found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
            for side, name in (("left", "l"), ("right", "r")))
    scored = (cuts.select("lang", "phrase", "a", "cut.*").join(l, ["lang", "left"]).join(r, ["lang", "right"])
              .withColumn("score", F.expr("cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + r)"))
              .groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))
              .select("lang", "phrase", "best.*"))
    inner = found.where("n_words > 2").select("lang", "f", F.explode(F.array(
        F.expr("substring_index(phrase, ' ', n_words - 1)"),
        F.expr("substring_index(phrase, ' ', 1 - n_words)"))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(most, ["lang", "phrase"], "left").where(
        F.expr("longer IS NULL OR cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * 80"))
    # first within parts of a language, so that the last window sees at most RANK_CUTS * top rows of it
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    for keys in (["lang", F.pmod(F.hash("phrase"), F.lit(RANK_CUTS))], ["lang"]):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
            F.col("rank") <= top)
    ranked = kept
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
        F.col("score").cast("long").alias("score"))
