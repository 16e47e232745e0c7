"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.session import checkpoint_dir

#: What the text operators delete or split on: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: cuts the lineage with
    files that outlive any executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without_spaces(col: Column) -> Column:
    """``col`` without any character of :data:`SPACES` (byte searches inside the JVM; NULL as '')."""
    out = F.coalesce(col.cast("string"), F.lit(""))
    for ch in SPACES:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns an operator is about to add (names compared as Spark does)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


#: Rows of an Arrow batch: texts are long, and both the JVM and the worker hold whole batches.
ROWS_A_BATCH = 1000


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow``, with the session's Arrow batches limited to :data:`ROWS_A_BATCH` rows."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= ROWS_A_BATCH:
        conf.set(key, str(ROWS_A_BATCH))
    return df.mapInArrow(run, schema)


#: Rows that `map_column` hands over at a time: bounds what a worker holds beside its Arrow batch.
ROWS_AT_ONCE = 64


def map_column(df: DataFrame, source: str, fn: Callable[[pa.Array], list[pa.Array]],
               *targets: tuple[str, T.DataType], drop_source: bool = False,
               after: Callable[[], None] | None = None) -> DataFrame:
    """``df`` with columns computed from the values of ``source``, some Arrow rows at a time: ``fn``
    takes an Arrow array and returns one for each of ``targets`` (name, Spark type). Columns of
    ``df`` named as a target are replaced. ``after`` runs at the end of every task."""
    names = [t[0] for t in targets]
    src = "__source"
    while src.lower() in {c.lower() for c in df.columns}:
        src += "_"
    rest = drop_columns(df, *names, *([source] if drop_source else []))
    rows = df.select(*[F.col(f"`{c}`") for c in rest.columns], F.col(f"`{source}`").alias(src))
    schema = T.StructType([*rest.schema.fields, *[T.StructField(n, t) for n, t in targets]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], *fn(batch.column(batch.num_columns - 1))],
                    names=[*batch.schema.names[:-1], *names])
        if after is not None:
            after()
        pa.default_memory_pool().release_unused()  # workers stay for other stages

    return map_arrow(rows, run, schema)


#: Up to so many ids (of a long, 8 bytes each) `without_ids` broadcasts.
MAX_BROADCAST_IDS = 500_000


def without_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``df`` whose id is not in ``ids`` (a column of that name). The ids are counted:
    up to :data:`MAX_BROADCAST_IDS` are broadcast, more are joined by a shuffle."""
    ids = ids.select(F.col(f"`{id_col}`")).distinct().checkpoint()
    return df.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, id_col, "left_anti")
