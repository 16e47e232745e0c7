"""Sources and sinks: S1 CSV with encoding fallback, S2 ``read_table`` dispatch, S3 ``combine``,
S4 ``rank_tables``, S5 cleaned CSV export, S6 report export, S7-S9 saved analyses.

Reading is lazy; the few decisions (which files need a second encoding, which text columns hold
numbers) come from one aggregate each. Writers split files by record count, never truncate.
"""

from __future__ import annotations

import csv
import datetime as _dt
import json
import re
import time
import uuid
import zlib
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.functions import naming as N
from sheetwise.session import checkpoint_dir
from sheetwise.sources import csv_records as CR

# Text the pandas CSV reader treats as missing by default.
PANDAS_NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
EXCEL_MAX_ROWS_PER_SHEET = 1_048_575
FALLBACK_ENCODING = "windows-1252"
#: Tables of up to so many files (header, encoding) are broadcast to the records; larger ones are joined by a shuffle.
MAX_BROADCAST_FILES = 1000

_INT = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(inf|Inf|INF|infinity|Infinity)$"


def _q(c: str):
    return F.col(f"`{c}`")


def infer_csv_types(df: DataFrame, surplus: str | None = None) -> DataFrame:
    """Text columns as the pandas reader types them: NA tokens become NULL, then a column whose
    non-NULL values are all integers becomes LONG, all numbers DOUBLE, all True/False BOOLEAN;
    anything else stays text. One aggregate decides every column. A value in the column ``surplus``
    (which is dropped) raises ValueError with the number of such rows."""
    cols = [c for c in df.columns if c != surplus]
    clean = df.select(*[F.when(~_q(c).isin(*PANDAS_NA_TOKENS), _q(c)).alias(c) for c in cols],
                      *[_q(surplus)] * (surplus is not None))
    aggs = [F.count(_q(surplus)).alias("surplus")] if surplus else []
    for i, c in enumerate(cols):
        v = F.trim(_q(c))
        nn = _q(c).isNotNull()
        aggs += [F.count(_q(c)).alias(f"n{i}"),
                 # integers that also fit a LONG (larger ones are read as DOUBLE, not lost)
                 F.count_if(nn & v.rlike(_INT) & v.try_cast("long").isNotNull()).alias(f"i{i}"),
                 F.count_if(nn & v.rlike(_FLOAT)).alias(f"f{i}"),
                 F.count_if(nn & v.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}")]
    r = clean.agg(*aggs).first()
    if surplus and r["surplus"]:
        raise ValueError(f"{r['surplus']} records have more fields than their header")
    sel = []
    for i, c in enumerate(cols):
        n = r[f"n{i}"]
        v = F.trim(_q(c))
        if n and r[f"i{i}"] == n:
            sel.append(v.try_cast("long").alias(c))
        elif n and r[f"f{i}"] == n:
            sel.append(v.try_cast("double").alias(c))
        elif n and r[f"b{i}"] == n:
            sel.append((F.lower(v) == "true").alias(c))
        else:
            sel.append(_q(c))
    return clean.select(*sel)


#: Bytes that windows-1252 leaves undefined: a file with one of them that is not UTF-8 is latin-1.
_NOT_1252 = "[\u0081\u008d\u008f\u0090\u009d]"
_BOM = "\ufeff"


def fallback_encoding(spark: SparkSession) -> str:
    """windows-1252 when the session allows Java charsets (``spark.sql.legacy.javaCharsets``),
    else ISO-8859-1 (the same for every byte but 0x80-0x9F)."""
    legacy = str(spark.conf.get("spark.sql.legacy.javaCharsets", "false")).lower() == "true"
    return FALLBACK_ENCODING if legacy else "ISO-8859-1"


def header_names(header: str) -> list[str]:
    """Column names of a header line; empty ones get ``_c<place>``, repeated ones their place."""
    names = next(csv.reader([header.lstrip(_BOM)]), [])
    out = [n if n else f"_c{i}" for i, n in enumerate(names)]
    low = [n.lower() for n in out]
    return [f"{n}{i}" if low.count(n.lower()) > 1 else n for i, n in enumerate(out)]


def read_csv(spark: SparkSession, path: str | list[str], infer_types: bool = True,
             multi_line: bool = True) -> DataFrame:
    """CSV files, each with a header record of its own, stacked by column name (a column that a file
    lacks is NULL there, whatever the order of its columns).

    Files are read as lines of bytes, so Spark splits large ones, also where quoted values hold line
    breaks (:mod:`sheetwise.sources.csv_records`). One aggregate decides, for each file, its header and
    its encoding: UTF-8 when every record is valid UTF-8, header included, else windows-1252 (see
    :func:`fallback_encoding`), else, with bytes that windows-1252 leaves undefined, latin-1. The
    decisions stay a table joined to the records; only the different headers reach the driver. A
    byte-order mark is dropped. Blank lines are skipped, except inside quotes. Records may end with
    a line feed, a return and a line feed, or, in files without quotes, a return alone.

    Fields that a record lacks are NULL; one with text after its closing quote keeps its quotes
    (``multi_line`` is accepted for older callers and changes nothing). A record with more fields than its header, or a file that
    ends inside a quoted value, raises ValueError (the former when types are inferred)."""
    paths = [path] if isinstance(path, str) else list(path)
    records = CR.records(spark, paths).withColumn("part", F.lit(0))
    latin = F.decode("value", "ISO-8859-1")
    if not records.where(latin.rlike("\r(?!$)") & ~latin.contains('"')).isEmpty():
        old = F.when(latin.contains('"'), F.array(latin)).otherwise(F.split(latin, "\r"))
        records = records.select("file", "block", "line", F.posexplode(old).alias("part", "t")).select(
            F.encode("t", "ISO-8859-1").alias("value"), "file", "block", "line", "part")
    else:
        records = records.withColumn("value", F.when(
            F.endswith("value", F.lit(b"\r")), F.substring("value", F.lit(1), F.octet_length("value") - 1)).otherwise(F.col("value")))
    lines = records.where(latin.rlike(r"\S"))
    place = F.struct("block", "line", "part")
    files = (lines.groupBy("file").agg(
        F.min_by(F.struct(place.alias("place"), "value"), place).alias("first"),
        F.bool_and(F.is_valid_utf8(F.col("value").cast("string"))).alias("utf8"),
        F.bool_or(latin.rlike(_NOT_1252)).alias("odd")))
    encoding = F.when(F.col("utf8"), "UTF-8").when(F.col("odd"), "ISO-8859-1").otherwise(fallback_encoding(spark))
    files = files.select("file", F.col("first.place").alias("header_place"), encoding.alias("encoding"),
                         F.col("first.value").alias("header_bytes"))

    def decoded(column):
        out = F.lit(None).cast("string")
        for name in ("UTF-8", fallback_encoding(spark), "ISO-8859-1"):
            out = F.when(F.col("encoding") == name, F.decode(column, name)).otherwise(out)
        return out

    files = files.withColumn("header", decoded(F.col("header_bytes"))).drop("header_bytes").checkpoint()
    headers = [r["header"] for r in files.groupBy("header").count().orderBy(F.col("count").desc(), "header").collect()]
    # a row a file: sending it to the records saves a shuffle of every record
    small = F.broadcast(files) if files.count() <= MAX_BROADCAST_FILES else files
    rows = (lines.join(small, "file").where(place != F.col("header_place"))
            .select("header", decoded(F.col("value")).alias("text")))
    out, surplus = None, "__more"
    for header in headers:
        names = header_names(header)
        schema = ", ".join(f"c{i} string" for i in range(len(names) + 1))  # one more shows surplus fields
        parsed = F.from_csv("text", schema, {"escape": '"', "mode": "PERMISSIVE", "multiLine": "true"})
        part = (rows.where(F.col("header") == header).select(parsed.alias("r"))
                .select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate([*names, surplus])]))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no lines in {paths}")
    return infer_csv_types(out, surplus) if infer_types else out.drop(surplus)


def read_table(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Dispatch on ``format`` or on the file extension: csv, json, parquet, orc.
    Anything else raises ValueError."""
    fmt = (format or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if fmt == "csv":
        return read_csv(spark, path, **options)
    if fmt in ("json", "jsonl", "ndjson"):
        return spark.read.options(**options).json(path)
    if fmt in ("parquet", "orc"):
        return spark.read.options(**options).format(fmt).load(path)
    raise ValueError("Unsupported file type")


def combine(named: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame, dict]:
    """S3: stack tables by column name (absent columns are NULL) with a ``source_file`` column.
    Returns (combined, per-file row counts [source_file, rows], summary dict with
    files_combined, columns_matched, total_rows). Raises ValueError on an empty list."""
    if not named:
        raise ValueError("No files to combine")
    col_sets = {frozenset(df.columns) for _, df in named}
    combined = None
    for name, df in named:
        part = df.withColumn("source_file", F.lit(name))
        combined = part if combined is None else combined.unionByName(part, allowMissingColumns=True)
    counts = combined.groupBy("source_file").agg(F.count("*").alias("rows"))
    rows = {r["source_file"]: r["rows"] for r in counts.collect()}  # one row per input table
    summary = {"files_combined": len(named), "file_row_counts": {n: rows.get(n, 0) for n, _ in named},
               "columns_matched": len(col_sets) == 1, "total_rows": int(sum(rows.values()))}
    return combined, counts, summary


def combine_files(spark: SparkSession, paths: list[str], format: str = "parquet") -> tuple[DataFrame, DataFrame, dict]:
    """S3 for many files: one scan over all of them (schemas merged by name, absent columns
    NULL) with ``source_file`` taken from the scan's ``_metadata.file_name`` - a single plan
    whatever the number of files, instead of one union branch per file. Returns (combined,
    per-file row counts, summary). ``columns_matched`` compares the files' own schemas (footer
    reads only, several at a time)."""
    if not paths:
        raise ValueError("No files to combine")
    fmt = format.lower()
    if fmt not in ("parquet", "orc", "json"):
        raise ValueError("combine_files reads parquet, orc or json; use combine() for CSV tables")
    reader = spark.read.option("mergeSchema", True) if fmt != "json" else spark.read
    raw = reader.format(fmt).load(list(paths))
    combined = raw.withColumn("source_file", F.col("_metadata.file_name"))
    counts = combined.groupBy("source_file").agg(F.count("*").alias("rows"))
    per_file = {r["source_file"]: r["rows"] for r in counts.collect()}  # one row per file
    with ThreadPoolExecutor(max_workers=8) as pool:
        schemas = set(pool.map(lambda p: frozenset(spark.read.format(fmt).load(p).columns), paths))
    matched = len(schemas) == 1
    summary = {"files_combined": len(paths), "file_row_counts": per_file, "columns_matched": matched,
               "total_rows": int(sum(per_file.values()))}
    return combined, counts, summary


def table_score_parts(name: str, df: DataFrame) -> DataFrame:
    """One aggregate: rows, columns, NULL cells and the name-based header factor of one table."""
    names = [str(c) for c in df.columns]
    k = len(names)
    avg_len = sum(len(c) for c in names) / max(k, 1)
    header = (1.0 if avg_len < 40 else 0.4) * (1 - sum(1 for c in names if c.lower().startswith("unnamed"))
                                               / max(k, 1) * 0.5)
    numeric = 1.0 if N.numeric_columns(df, include_internal=True) else 0.6
    nulls = sum((F.count_if(_q(c).isNull()) for c in names), F.lit(0)) if names else F.lit(0)
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.lit(k).alias("cols"),
                  nulls.cast("long").alias("null_cells"), F.lit(header).alias("header"),
                  F.lit(numeric).alias("numeric"))


def rank_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """S4 (re-aimed sheet ranking): ``[name, score]`` most table-like first.
    score = min(rows,1000) * min(cols,20) * header * max(fill, 0.1) * numeric, rounded to 2;
    an empty table (no rows or no columns) scores 0."""
    parts = None
    for name, df in tables.items():
        p = table_score_parts(name, df)
        parts = p if parts is None else parts.unionByName(p)
    cells = F.col("rows") * F.col("cols")
    fill = F.when(cells > 0, 1 - F.col("null_cells") / cells).otherwise(F.lit(0.0))
    score = (F.least(F.col("rows"), F.lit(1000)) * F.least(F.col("cols"), F.lit(20)) * F.col("header")
             * F.greatest(fill, F.lit(0.1)) * F.col("numeric"))
    return (parts.select("name", F.when(cells > 0, F.bround(score, 2)).otherwise(F.lit(0.0)).alias("score"))
                 .orderBy(F.col("score").desc(), F.col("name")))


def drop_internal(df: DataFrame) -> DataFrame:
    return df.select(*[_q(c) for c in df.columns if not N.is_internal(c)])


def export_csv(df: DataFrame, path: str, max_records_per_file: int | None = None) -> None:
    """The table without internal columns as CSV files with a header. Quotes inside values are
    doubled and white space at their ends is kept, so :func:`read_csv` gives them back."""
    w = drop_internal(df).write.mode("overwrite").option("header", True).option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False) \
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.csv(path)


def export_report(base: str, cleaned: DataFrame, stats: DataFrame | None = None,
                  anomalies: DataFrame | None = None, labels: dict | None = None) -> list[str]:
    """S6 (re-aimed workbook): up to three CSV folders - cleaned data, statistics, anomalies -
    with readable column labels and at most 1,048,575 records per file (the sheet limit), so
    large tables are exported whole. Returns the folders written."""
    from sheetwise.operators.profile import relabel
    out = []
    for name, df in (("cleaned_data", cleaned), ("descriptive_stats", stats), ("anomalies", anomalies)):
        if df is None:
            continue
        path = f"{base.rstrip('/')}/{name}"
        export_csv(relabel(df, labels), path, EXCEL_MAX_ROWS_PER_SHEET)
        out.append(path)
    return out


# --- S7-S9 saved analyses --------------------------------------------------------------------
#
# An append-only log: every save and every delete appends one row to root/log; nothing is rewritten in
# place. Of the rows of one analysis the newest version wins, and a tombstone hides it. A job that stops
# anywhere leaves either the old state or the new one: data is written before its log row, a
# tombstone before its data goes. Users are told apart by a column, files by a hash of
# the user, so no path is ever built from a caller's text.

LOG_SCHEMA = ("analysis_id string, user_id string, name string, created_at timestamp, rows long, cols int, "
              "report string, deleted boolean, version string, data string, user_part int")
#: Parts of the log by a hash of the user: a listing reads one of them.
USER_PARTS = 64


def _user_part(user_id: str) -> int:
    return zlib.crc32(user_id.encode()) % USER_PARTS


def _version() -> str:
    """Later versions are larger; two in the same nanosecond differ."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def _append(spark: SparkSession, root: str, row: tuple) -> None:
    (spark.createDataFrame([row], LOG_SCHEMA).coalesce(1).write.mode("append").partitionBy("user_part")
     .parquet(_log_folder(spark, root)))


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _log_folder(spark: SparkSession, root: str) -> str:
    """The folder of the log's newest generation: ``log/g<number>``, complete once ``log/g<number>.ready``
    is there. The first needs no mark."""
    base = f"{root.rstrip('/')}/log"
    fs, path = _hadoop(spark, base)
    ready = [0]
    if fs.exists(path):
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        ready += [int(n[1:-6]) for n in names if re.fullmatch(r"g[0-9]+\.ready", n)]
    return f"{base}/g{max(ready)}"


def _entries(spark: SparkSession, root: str, user_id: str | None = None) -> DataFrame:
    """The newest row of every analysis, deleted ones too (of one user, reading that user's part only)."""
    folder = _log_folder(spark, root)
    fs, path = _hadoop(spark, folder)
    if not fs.exists(path):
        return spark.createDataFrame([], LOG_SCHEMA)
    log = spark.read.schema(LOG_SCHEMA).parquet(folder)
    if user_id is not None:
        log = log.where((F.col("user_part") == _user_part(user_id)) & (F.col("user_id") == user_id))
    newest = F.max_by(F.struct(*[c for c in log.columns if c not in ("user_id", "analysis_id")]), "version")
    return log.groupBy("user_id", "analysis_id").agg(newest.alias("e")).select("user_id", "analysis_id", "e.*")


def save_analysis(spark: SparkSession, root: str, user_id: str, name: str, cleaned: DataFrame,
                  report: dict, analysis_id: str | None = None) -> str:
    """The cleaned table as Parquet in a new folder under ``root/data``, then one row appended to
    the log. Returns the analysis id. Saving under an id that the user already has makes a new version of it;
    the old table stays until :func:`compact_analyses`."""
    analysis_id, user_id, version = analysis_id or uuid.uuid4().hex, str(user_id), _version()
    data = f"data/{version}"
    cleaned.write.parquet(f"{root.rstrip('/')}/{data}")
    _append(spark, root, (analysis_id, user_id, name, _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None),
                          int(report.get("cleaned_rows", 0)), int(report.get("original_cols", len(cleaned.columns))),
                          json.dumps(report, default=str), False, version, data, _user_part(user_id)))
    return analysis_id


def list_saved_analyses(spark: SparkSession, root: str, user_id: str) -> DataFrame:
    """Metadata of one user's analyses, newest first (only that user's part of the log is read)."""
    return (_entries(spark, root, str(user_id)).where(~F.col("deleted"))
            .select("analysis_id", "name", "created_at", "rows", "cols")
            .orderBy(F.col("created_at").desc(), "analysis_id"))


def _entry(spark: SparkSession, root: str, user_id: str, analysis_id: str):
    return _entries(spark, root, str(user_id)).where((F.col("analysis_id") == analysis_id) & ~F.col("deleted")).first()


def load_analysis(spark: SparkSession, root: str, user_id: str, analysis_id: str) -> tuple[DataFrame, dict]:
    """The saved table and its report (the newest version)."""
    entry = _entry(spark, root, user_id, analysis_id)
    if entry is None:
        raise ValueError(f"no analysis {analysis_id} for user {user_id}")
    return spark.read.parquet(f"{root.rstrip('/')}/{entry['data']}"), json.loads(entry["report"])


def delete_analysis(spark: SparkSession, root: str, user_id: str, analysis_id: str) -> bool:
    """Remove one user's saved analysis; False when the user has none of that id. A tombstone is
    appended first, then the table goes: a job stopped in between leaves an unlisted table, which
    :func:`compact_analyses` removes."""
    entry = _entry(spark, root, user_id, analysis_id)
    if entry is None:
        return False
    _append(spark, root, tuple({**entry.asDict(), "deleted": True, "version": _version()}[c.split()[0]]
                               for c in LOG_SCHEMA.split(", ")))
    fs, path = _hadoop(spark, f"{root.rstrip('/')}/{entry['data']}")
    fs.delete(path, True)
    return True


def compact_analyses(spark: SparkSession, root: str) -> int:
    """Rewrites the log with one row for every analysis that is there, and removes tables that no row
    names. The new generation is written whole and marked ready before anything old goes; a stopped
    compaction changes nothing that a reader sees. Returns the number of analyses. Run it while
    nobody saves: rows appended to the old generation meanwhile would be lost."""
    old = _log_folder(spark, root)
    number = int(old.rsplit("/g", 1)[1]) + 1
    base = old.rsplit("/", 1)[0]
    fs, target = _hadoop(spark, f"{base}/g{number}")
    fs.delete(target, True)  # what a stopped compaction left
    kept = _entries(spark, root).where(~F.col("deleted")).select(*[c.split()[0] for c in LOG_SCHEMA.split(", ")]).checkpoint()
    kept.repartition("user_part").write.partitionBy("user_part").parquet(f"{base}/g{number}")
    fs.create(_hadoop(spark, f"{base}/g{number}.ready")[1]).close()
    fs.delete(_hadoop(spark, old)[1], True)
    _, data = _hadoop(spark, f"{root.rstrip('/')}/data")
    if fs.exists(data):
        folders = [f"data/{f.getPath().getName()}" for f in fs.listStatus(data)]
        unused = spark.createDataFrame([(f,) for f in folders], "data string").join(kept, "data", "left_anti")
        for row in unused.toLocalIterator():
            fs.delete(_hadoop(spark, f"{root.rstrip('/')}/{row['data']}")[1], True)
    return kept.count()


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's checkpoint folder (shared by all executors)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/sheetwise-{purpose}-{uuid.uuid4().hex}"
