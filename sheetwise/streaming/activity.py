"""Usage reports kept up to date from a growing event log (Structured Streaming).

The activity log only ever grows (one row per logged event), so the daily activity report (U3)
can be maintained incrementally: the stream keeps one state row per (day, session) - exactly what
an exact distinct-session count needs - and each micro-batch writes a new version of the small
per-day report from that state; readers take the newest complete version, so a report is never
missing or half-written. State grows with the log; :func:`daily_activity_windows` is the form
with bounded state. The checkpoint lives in the cluster's checkpoint folder, so a restarted query
resumes where it stopped (exactly-once through the file source and sink commit logs).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwise.session import checkpoint_dir


def daily_activity_stream(events: DataFrame, ts: str = "ts", session: str = "session_id") -> DataFrame:
    """Streaming aggregate: events per (day, session)."""
    return (events.select(F.to_date(ts).alias("day"), F.col(session).alias("session"))
                  .groupBy("day", "session").agg(F.count("*").alias("events")))


def run_daily_activity(spark: SparkSession, events_path: str, out_path: str, ts: str = "ts",
                       session: str = "session_id", checkpoint: str | None = None,
                       available_now: bool = True):
    """Start (and, with ``available_now``, finish) the incremental U3 report over the parquet
    files under ``events_path``; every micro-batch writes the report ``[day, events, sessions]`` to a
    folder of its own under ``out_path`` (a repeated batch to the same one). Returns the StreamingQuery;
    :func:`latest_report` reads the report."""
    schema = spark.read.parquet(events_path).schema
    stream = spark.readStream.schema(schema).parquet(events_path)
    per_session = daily_activity_stream(stream, ts, session)

    def publish(batch: DataFrame, batch_id: int) -> None:
        (batch.groupBy("day")
              .agg(F.sum("events").alias("events"), F.count("session").alias("sessions"))
              .write.mode("overwrite").parquet(f"{out_path}/report={batch_id:012d}"))

    tag = hashlib.sha1(out_path.encode()).hexdigest()[:16]
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/daily-activity-{tag}"
    writer = (per_session.writeStream.outputMode("complete")
                         .option("checkpointLocation", ckpt)
                         .foreachBatch(publish))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def daily_activity(spark: SparkSession, events_path: str, out_path: str, ts: str = "ts",
                   session: str = "session_id") -> DataFrame:
    """Run the stream over everything present now, then read the published report."""
    q = run_daily_activity(spark, events_path, out_path, ts, session, available_now=True)
    q.awaitTermination()
    return latest_report(spark, out_path).orderBy("day")


def latest_report(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest version of the report whose write was committed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(out_path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [str(f.getPath()) for f in store.listStatus(folder) if store.exists(hadoop.Path(f.getPath(), "_SUCCESS"))]
    if not done:
        raise ValueError(f"no report under {out_path}")
    return spark.read.parquet(max(done))


def daily_activity_windows(events: DataFrame, ts: str = "ts", session: str = "session_id",
                           watermark: str = "1 day") -> DataFrame:
    """Bounded-state form of the daily report: a watermark on the event time, then two chained
    windowed aggregates (per day and session, then per day). In append mode a day is emitted
    once, when the watermark passes its end, and its state is dropped - state is bounded by the
    sessions of the days still open, not by the whole log. Late events beyond the watermark are
    not counted (the documented trade-off of watermarks)."""
    # watermarks need TIMESTAMP; a zone-free timestamp is read as wall-clock time in the
    # session zone, and the day is taken back in that zone, so days match the batch report
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    per_session = (timed.withWatermark(ts, watermark)
                        .groupBy(F.window(ts, "1 day").alias("w"), F.col(session).alias("session"))
                         .agg(F.count("*").alias("events")))
    return (per_session.groupBy("w")
                       .agg(F.sum("events").alias("events"), F.count("session").alias("sessions"))
                       .select(F.to_date(F.col("w.start")).alias("day"), "events", "sessions"))


def run_daily_activity_bounded(spark: SparkSession, events_path: str, out_path: str, ts: str = "ts",
                               session: str = "session_id", watermark: str = "1 day",
                               checkpoint: str | None = None, available_now: bool = True):
    """Start the bounded-state daily report: closed days are appended to parquet under
    ``out_path`` (exactly once, through the file sink's commit log)."""
    schema = spark.read.parquet(events_path).schema
    stream = spark.readStream.schema(schema).parquet(events_path)
    tag = hashlib.sha1(("bounded:" + out_path).encode()).hexdigest()[:16]
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/daily-activity-{tag}"
    writer = (daily_activity_windows(stream, ts, session, watermark)
              .writeStream.outputMode("append").format("parquet")
              .option("path", out_path).option("checkpointLocation", ckpt))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
