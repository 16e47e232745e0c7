"""Repeated passages by a sparse suffix array.

**Sampling.** Of a document's suffixes those at minimiser positions are retained: in every run of
``MIN_WORDS`` words the suffix whose first ``K`` words hash lowest (leftmost of ties). Two equal runs
retain the suffix at the same place, so nothing of that length is missed, at about one suffix in
eighteen words.

**Sorting.** The suffixes are ordered by content: by their first ``K`` words, then by everything
that a run of ``MIN_WORDS`` words around them can hold (their context). Suffixes whose first words
occur in one document only are dropped there. Equal contexts are neighbours in this order and need
no further look: their whole context repeats. One suffix of each different context under shared
first words goes on.

**Extension.** Those are extended left and right: every run of ``MIN_WORDS`` words that holds them as
its minimiser is ordered by content again, and equal neighbours from different documents are
repeats. What was found around it holds for every suffix with its context. Overlapping repeats of a document join into maximal passages. The result is exact: the
words that are covered by a run of at least ``MIN_WORDS`` words that occurs in another document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.llm.common import map_arrow, written
from sheetwise.llm.shingles import POWERS, mix, shingles, word_hashes

MIN_WORDS = 50
K = 16


class RunHashes:
    """Hashes of any runs of words of one text, from one pass of prefix sums modulo 2^64."""

    def __init__(self, hashes: np.ndarray):
        up, self._down = POWERS.upto(len(hashes) + 1)
        self._prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * up[:-1])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._prefix[end] - self._prefix[start]) * self._down[start]
                   + (end - start).astype(np.uint64))


def minimisers(hashes: np.ndarray, min_words: int = MIN_WORDS, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(minimiser of every run of ``min_words`` words, hash of the ``k`` words at every position)."""
    grams = shingles(hashes, k) if len(hashes) >= min_words else np.zeros(0, np.uint64)
    if not len(grams):
        return np.zeros(0, np.int64), grams
    width = min_words - k + 1
    # leftmost lowest of each window: lowest of doubling spans, ties to the left
    order = grams
    lowest, at = order.copy(), np.arange(len(grams))
    span = 1
    while span * 2 <= width:
        right = lowest[span:] < lowest[:-span]
        at = np.where(right, at[span:], at[:-span])
        lowest = np.where(right, lowest[span:], lowest[:-span])
        span *= 2
    rest = width - span
    if rest:
        right = lowest[rest:] < lowest[:-rest]
        at = np.where(right, at[rest:], at[:-rest])
    return at, grams


def _retained(text: str | None, min_words: int, k: int):
    """Positions, first-word hashes and context hashes of a text's retained suffixes."""
    h = word_hashes(text)
    at, grams = minimisers(h, min_words, k)
    pos = np.unique(at)
    reach = min_words - k
    start, end = np.maximum(pos - reach, 0), np.minimum(pos + min_words, len(h))
    context = RunHashes(h).of(start, end) if len(pos) else np.zeros(0, np.uint64)
    # a context cut short by a text's end is not that of a longer one
    cut = (pos - start) * (2 * min_words) + (end - pos)
    return pos, grams[pos], mix(context + cut.astype(np.uint64)), start, end


def retained_suffixes(docs: DataFrame, min_words: int, k: int) -> DataFrame:
    """(doc, pos, key, context, start, end): the sampled suffixes and their contexts' words."""
    def run(batches):
        for batch in batches:
            docs_, held, n = [], [[] for _ in range(5)], 0
            ids, texts = batch.columns
            for i in range(batch.num_rows):
                got = _retained(texts[i].as_py(), min_words, k)
                if len(got[0]):
                    docs_.append(np.full(len(got[0]), i))
                    for column, values in zip(held, got, strict=True):
                        column.append(values)
                    n += len(got[0])
                if n > 100_000 or n and i == batch.num_rows - 1:
                    pos, key, context, start, end = (np.concatenate(c) for c in held)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(np.concatenate(docs_))), pa.array(pos.astype(np.int32)),
                         pa.array(key.view(np.int64)), pa.array(context.view(np.int64)),
                         pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))],
                        names=["doc", "pos", "key", "context", "start", "end"])
                    docs_, held, n = [], [[] for _ in range(5)], 0

    kind = docs.schema["doc"].dataType.simpleString()
    return map_arrow(docs, run, f"doc {kind}, pos int, key long, context long, start int, end int")


def runs_around(chosen: DataFrame, docs: DataFrame, min_words: int, k: int) -> DataFrame:
    """(run, doc, hi, start, pos): every run of ``min_words`` words whose minimiser is a chosen
    suffix. ``chosen``: doc, and its suffixes ``at`` as array of (pos, hi)."""
    rows = docs.join(chosen, "doc").select("doc", "text", "at")
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, texts, ats = batch.columns
            for i in range(batch.num_rows):
                h = word_hashes(texts[i].as_py())
                of_run, _ = minimisers(h, min_words, k)
                want = ats[i].values.flatten()
                pos, hi = (c.to_numpy(zero_copy_only=False) for c in want)
                order = np.argsort(pos, kind="stable")
                place = np.searchsorted(pos[order], of_run)
                place = np.minimum(place, len(pos) - 1)
                starts = np.flatnonzero(pos[order][place] == of_run)
                which = order[place[starts]]
                found = RunHashes(h).of(starts, starts + min_words)
                own = np.zeros(len(starts), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.view(np.int64)), ids.take(pa.array(own + i)), pa.array(hi[which]),
                     pa.array(starts.astype(np.int32)), pa.array(pos[which])],
                    names=["run", "doc", "hi", "start", "pos"])

    return map_arrow(rows, run, f"run long, doc {kind}, hi {kind}, start int, pos int")


def repeated_passages(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                      min_words: int = MIN_WORDS, k: int = K) -> DataFrame:
    """(id_col, first_word, n_words, first_id): the maximal passages of every document that are covered
    by runs of ``min_words`` or more words occurring in another document too; words are lower-cased
    (A-Z) and parted by space, tab, line feed, vertical tab, form feed or return. ``first_id`` is the
    smallest id that has some of those runs: the passage's own id where it is the first to show it.

    Texts with fewer words, NULL and empty texts have no passages. Rows that share an id are one
    document; rows without an id are left out; other columns are ignored; an empty table gives an
    empty result. Ids are integers. Hashes have 64 bits.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).where(
        "doc is not null")
    suffixes = written(retained_suffixes(docs, min_words, k), "suffixes")
    contexts = suffixes.groupBy("key", "context").agg(
        F.min(F.struct("doc", "pos")).alias("first"), F.max("doc").alias("hi"))
    shared = contexts.groupBy("key").agg(
        F.min("first.doc").alias("a"), F.max("hi").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b")
    sorted_out = written(contexts.join(shared, "key").select(
        "key", "context", F.col("first.doc").alias("lo"), F.col("first.pos").alias("pos"), "hi",
        (F.col("n") > 1).alias("several")), "contexts")

    chosen = (sorted_out.where("several").groupBy(F.col("lo").alias("doc"))
              .agg(F.collect_list(F.struct("pos", "hi")).alias("at")))
    runs = written(runs_around(written(chosen, "chosen"), docs, min_words, k), "runs")
    # grouped with map-side combining and joined back, so that a run that very many documents share
    # does not meet in one task
    repeated = (runs.groupBy("run").agg(F.min("doc").alias("a"), F.max("hi").alias("b")).where("a <> b")
                .select("run", "a").checkpoint())
    # the repeated runs around a suffix all hold it, and so are one stretch of words
    extended = written(
        runs.join(repeated, "run").groupBy("doc", "pos").agg(
            F.min("start").alias("start"), (F.max("start") + min_words).alias("end"),
            F.min("a").alias("first_id")), "extended")

    # every suffix of an extended one's context has the same runs around it, be it in the same document
    elsewhere = extended.select(F.col("doc").alias("lo"), "pos", (F.col("start") - F.col("pos")).alias("left"),
                                (F.col("end") - F.col("pos")).alias("right"), "first_id")
    repeats = (sorted_out.join(elsewhere, ["lo", "pos"], "left").where("lo <> hi or first_id is not null")
               .select("key", "context", F.coalesce("first_id", "lo").alias("first_id"),
                       F.when(F.col("lo") == F.col("hi"), F.col("left")).alias("left"),
                       F.when(F.col("lo") == F.col("hi"), F.col("right")).alias("right")))
    spans = suffixes.join(repeats, ["key", "context"]).select(
        "doc", F.coalesce(F.col("pos") + F.col("left"), "start").alias("start"),
        F.coalesce(F.col("pos") + F.col("right"), "end").alias("end"), "first_id")
    return _joined(spans).withColumnRenamed("doc", id_col)


def _joined(spans: DataFrame) -> DataFrame:
    """Overlapping or touching spans of a document as one."""
    order = Window.partitionBy("doc").orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.max("end").over(before), F.lit(-1)) < F.col("start")
    return (spans.withColumn("fresh", fresh.cast("int"))
            .withColumn("passage", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("doc", "passage")
            .agg(F.min("start").alias("first_word"), F.max("end").alias("last"), F.min("first_id").alias("first_id"))
            .select("doc", "first_word", (F.col("last") - F.col("first_word")).alias("n_words"), "first_id"))


def without_repeats(df: DataFrame, passages: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``df`` with every passage cut out of the texts but in the document that shows it first."""
    cuts = (passages.where(F.col("first_id") != F.col(id_col)).groupBy(F.col(id_col).alias("__id"))
            .agg(F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias("__cuts")))
    joined = df.join(cuts, F.col(f"`{id_col}`") == F.col("__id"), "left").drop("__id")

    def kept(text, spans):
        words = F.split(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), " ")
        inside = lambda i: F.exists(spans, lambda s: (i >= s["first_word"]) & (i < s["first_word"] + s["n_words"]))
        return F.array_join(F.filter(words, lambda w, i: ~inside(i)), " ")

    text = F.col(f"`{text_col}`")
    return joined.withColumn(text_col, F.when(F.col("__cuts").isNull(), text)
                             .otherwise(kept(text, F.col("__cuts")))).select(*df.columns)
