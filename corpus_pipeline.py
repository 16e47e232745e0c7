"""The training-data pipeline over ``documents``: five stages, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``; all but the last return the columns of ``documents``. Document ids
are taken as unique: where a stage drops an id, it drops every row with it. Rows without an id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.llm.bpe_automaton import encode_and_decode
from sheetwise.llm.common import table, without_ids, written
from sheetwise.llm.decontaminate import find_contamination
from sheetwise.llm.exact_dedup import exact_dedup
from sheetwise.llm.language_id import fit_limits, held_out, in_language, train
from sheetwise.llm.ngram_join import near_duplicates
from sheetwise.llm.registry import tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language: letterless ones go, those in no learnt language (by code length a byte) and
    those in two (by the distance to the second language). Three quarters of the labelled rows train, all the others
    give the limits."""
    apart = held_out(F.col("doc_id"))
    model = train(docs.where(~apart))
    return in_language(docs, model, fit_limits(docs.where(apart), model))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of texts equal but for white space."""
    return exact_dedup(docs).where("kept").select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: five-word shingles, Jaccard 0.8 or more."""
    groups = near_duplicates(docs, n=5, num=4, den=5)
    return without_ids(docs, groups.where("component_id <> doc_id"), "doc_id").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return without_ids(docs, found, "doc_id").select(*docs.columns)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with their number and whether decoding gives the text back."""
    path = tokenizer_path()
    coded = encode_and_decode(docs, path, ids_col="ids", decoded_col="decoded")
    return coded.select(
        *docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("ngram_jaccard_join", near_stage),
    ("decontamination", benchmark_stage),
    ("bpe", token_stage),
]

#: Language models and token automata are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
