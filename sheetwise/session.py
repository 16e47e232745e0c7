"""Session helpers.

The library never invents storage locations on a cluster: lineage cuts go to the folder the cluster
names in ``spark.checkpoint.dir``. Only test and benchmark entry points may fill that setting in
when it is unset (``ensure_checkpoint_dir(..., allow_local=True)``).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Parquet timestamps written without a zone are read as TIMESTAMP_NTZ.
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    # lets the CSV reader decode windows-1252 (Spark 4 otherwise allows a short charset list)
    "spark.sql.legacy.javaCharsets": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "sheetwise", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; raises when the cluster names none."""
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; set it to a folder shared by all executors "
        "(HDFS, S3, ...) before running operators that cut lineage")


def ensure_checkpoint_dir(spark: SparkSession, allow_local: bool = False) -> str:
    """Return the session's checkpoint folder. Test and bench entry points pass
    ``allow_local=True`` so that an unset setting is filled with a fresh local folder when the
    master is ``local`` or ``local[...]``."""
    try:
        return checkpoint_dir(spark)
    except RuntimeError:
        # one machine only: elsewhere executors would not see the driver's own folder
        if not allow_local or not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise
        path = tempfile.mkdtemp(prefix="sheetwise-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(path)
        return spark.sparkContext.getCheckpointDir()


def written(df, purpose: str):
    """``df`` written as Parquet into the session's checkpoint folder and read back: one computation
    for several readers, in files that outlive any executor."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/sheetwise-{purpose}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
