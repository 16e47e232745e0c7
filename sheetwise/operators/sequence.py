"""Global row position without a single-partition window.

``row_number() OVER (ORDER BY ...)`` with no partition moves every row into one task. Instead:
range-partition on the order (plus a row hash, so even one hot key is split over many tasks),
sort within partitions, stamp each row with its partition and in-partition sequence, cut the
lineage into the cluster's checkpoint folder (so the stamps cannot change on recomputation), then
add the prefix sum of the per-partition counts. The offset table has one row per partition: a
proven size bound, so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.operators.topk import row_hash
from sheetwise.session import checkpoint_dir


def with_position(df: DataFrame, order_cols: list[str], name: str = "t",
                  partitions: int | None = None) -> DataFrame:
    """``df`` plus a 0-based LONG column ``name``: the row's position in ascending order of
    ``order_cols``. Rows equal on ``order_cols`` are ordered by a hash of the whole row, so
    positions are repeatable."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = list(order_cols) + ["_tb"]
    stamped = (df.withColumn("_tb", row_hash(df, 42))
                 .repartitionByRange(n_parts, *keys)
                 .sortWithinPartitions(*keys)
                 .withColumn("_pid", F.spark_partition_id())
                 .withColumn("_mid", F.monotonically_increasing_id())
                 .checkpoint(eager=True))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (stamped.groupBy("_pid")
                      .agg(F.count("*").alias("_n"), F.min("_mid").alias("_m0"))
                      .withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
                      .select("_pid", "_m0", "_off"))
    return (stamped.join(F.broadcast(offsets), on="_pid")
                   .withColumn(name, (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long"))
                   .drop("_tb", "_pid", "_mid", "_m0", "_off"))
