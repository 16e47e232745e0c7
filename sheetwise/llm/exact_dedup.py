"""Exact deduplication by two-pass Bloom filtering, DataFrame functions only.

Pass 1 hashes every text and keeps, of a Bloom filter's bit positions, those hit at least twice:
a text whose two positions were not both hit twice occurs once. Pass 2 tests every row against
that filter: rows that fail are unique and never leave their partition; only rows that pass are
shuffled, by the SHA-256 of their normalised text, and grouped exactly.

The filter is kept sparse, as (word number, 64-bit mask) of non-zero words. It is broadcast when
it has at most ``max_broadcast_words`` rows (counted first); beyond that the test is an ordinary
shuffled join of (key, hash) rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.llm.common import drop_columns, without_spaces

BITS_PER_ROW = 32
MAX_BITS = 1 << 36
MAX_BROADCAST_WORDS = 1_000_000
DECISION_COLUMNS = ("keep_id", "group_size", "kept", "text_sha256")


def filter_bits(n_rows: int, bits_per_row: int = BITS_PER_ROW, max_bits: int = MAX_BITS) -> int:
    """Size of the filter: the next power of two of ``bits_per_row`` bits a row, at most
    ``max_bits`` (a smaller filter only lets more unique rows through to the exact grouping)."""
    return min(max_bits, 1 << max(16, math.ceil(math.log2(max(1, n_rows) * bits_per_row))))


def _positions(text_hash, n_bits: int):
    other = F.xxhash64(text_hash, F.lit(7))
    return [F.shiftrightunsigned(h, 20).bitwiseAND(F.lit(n_bits - 1)) for h in (text_hash, other)]


def repeated_positions(hashes: DataFrame, n_bits: int) -> DataFrame:
    """Pass 1: ``hashes`` (column ``_h``) to the filter's non-zero words (``_word``, ``_mask``)."""
    hit_twice = (hashes
                 .select(F.explode(F.array(*_positions(F.col("_h"), n_bits))).alias("_p"))
                 .groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
                 .where("_n > 1"))
    bit = F.expr("shiftleft(1L, cast(_p & 63 as int))")
    return (hit_twice.groupBy(F.shiftright("_p", 6).alias("_word"))
            .agg(F.bit_or(bit).alias("_mask")))


def possibly_repeated(rows: DataFrame, words: DataFrame, n_bits: int, broadcast: bool) -> DataFrame:
    """Pass 2: adds ``_again``, true where both positions of ``_h`` are set in the filter."""
    out = rows
    for i, pos in enumerate(_positions(F.col("_h"), n_bits)):
        side = words.select(F.col("_word").alias(f"_word{i}"), F.col("_mask").alias(f"_mask{i}"))
        out = (out.withColumn(f"_p{i}", pos)
               .join(F.broadcast(side) if broadcast else side,
                     F.shiftright(F.col(f"_p{i}"), 6) == F.col(f"_word{i}"), "left"))
    hit = [F.coalesce(F.expr(f"shiftrightunsigned(_mask{i}, cast(_p{i} & 63 as int)) & 1L"), F.lit(0)) == 1
           for i in (0, 1)]
    return out.withColumn("_again", hit[0] & hit[1]).drop(
        *[f"{c}{i}" for c in ("_word", "_mask", "_p") for i in (0, 1)])


def exact_dedup(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                bits_per_row: int = BITS_PER_ROW,
                max_broadcast_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """Every row of ``df`` with its decision: ``keep_id`` (id of the row that stays of its group),
    ``group_size``, ``kept`` and ``text_sha256`` (of the text without white space).

    Texts are equal when identical after deleting space, tab, line feed, vertical tab, form feed
    and return; NULL counts as empty, and empty texts are equal to one another. The row with the
    most code points in the original text stays, then the smallest id (NULL last). Rows that
    repeat an id: all rows with the winning id and length stay. Columns of ``df`` named as an
    output column are replaced; an empty table gives an empty result.
    """
    src = drop_columns(df, *DECISION_COLUMNS)
    norm = without_spaces(F.col(f"`{text_col}`"))
    rows = src.select(
        "*", F.sha2(norm.cast("binary"), 256).alias("text_sha256"), F.xxhash64(norm).alias("_h"),
        F.length(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("_len"),
        F.col(f"`{id_col}`").alias("_id"))
    n_bits = filter_bits(src.count(), bits_per_row)
    words = repeated_positions(rows.select("_h"), n_bits).checkpoint()
    tested = possibly_repeated(rows, words, n_bits, words.count() <= max_broadcast_words)

    once = tested.where("not _again").select(
        *[F.col(f"`{c}`") for c in src.columns], F.col("_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = tested.where("_again")
    groups = (again.groupBy(F.col("text_sha256").alias("_sha"))
              .agg(F.min(F.struct((-F.col("_len")).alias("l"), F.col("_id").isNull().alias("n"),
                                  F.col("_id").alias("id"))).alias("_best"),
                   F.count(F.lit(1)).alias("group_size"))
              .checkpoint())  # a plain table beside the join, so that a hot group's side can be split
    grouped = (again.join(groups, F.col("text_sha256") == F.col("_sha"))
               .select(*[F.col(f"`{c}`") for c in src.columns], F.col("_best.id").alias("keep_id"),
                       "group_size",
                       (F.col("_id").eqNullSafe(F.col("_best.id"))
                        & (-F.col("_len") == F.col("_best.l"))).alias("kept"),
                       "text_sha256"))
    return once.unionByName(grouped)
