"""Records of CSV files whose quoted values hold line breaks, read split by split.

A split cannot know whether it begins inside a quoted value. So every split is read under both
assumptions: it gives the state at its end for either state at its start (a function on two states; a
line with no quote is the identity), and a prefix combination of these functions over a file's splits gives
every split its true start. Only lines with a quote are looked at for that, and only files in which some
value really goes on after a line end are assembled.

Assembling reads a split once more under both assumptions, until both agree that a record ends at a
line end (mostly at its first few lines); from there on its records are the same. Records that lie in
several splits come out as parts, at most two a split, and are put together in the order of splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheetwise.session import written

# A line that begins at a field and ends outside quotes. A field is quoted only if a quote is its
# first character; after its closing quote, and in other fields, quotes are ordinary characters.
_FIELD = rb'(?:(?:"[^"]*+")++(?!")[^,]*+|[^",][^,]*+|)'
_closed = re.compile(_FIELD + rb"(?:," + _FIELD + rb")*+").fullmatch


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted value is open at the end of ``line``, given whether one is at its start."""
    if b'"' not in line:
        return inside
    return _closed(b'"' + line if inside else line) is None


def raw_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files' lines as bytes (cut at line feeds only): ``value``, ``file``, ``block``, ``line``.
    The order of a file's lines is that of (block, line)."""
    return (spark.read.option("lineSep", "\n").text(paths)
            .select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")))


def _split_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "block", "from_out", "from_in", "open_out", "open_in"]
    at, state, opened, out = None, [False, True], [False, False], []
    for batch in batches:
        for file, block, line in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (file, block) != at:
                if at is not None:
                    out.append((*at, *state, *opened))
                at, state, opened = (file, block), [False, True], [False, False]
            first = ends_inside(line, state[0])
            state = [first, first if state[0] == state[1] else ends_inside(line, state[1])]
            opened = [opened[0] or state[0], opened[1] or state[1]]
    if at is not None:
        out.append((*at, *state, *opened))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)


def splits(lines: DataFrame) -> DataFrame:
    """Every split that holds a quote: ``file``, ``block``, ``starts_in`` and ``ends_in`` (whether it
    begins and ends inside a quoted value) and ``opens`` (whether a value goes on after one of its lines)."""
    quoted = lines.where(F.decode("value", "ISO-8859-1").contains('"')).select("file", "block", "value")
    found = quoted.mapInArrow(_split_functions, "file string, block long, from_out boolean, from_in boolean, "
                                                "open_out boolean, open_in boolean").checkpoint()
    return _combined(found).select(
        "file", "block", "starts_in", F.when(F.col("starts_in"), F.col("from_in")).otherwise(F.col("from_out")).alias("ends_in"),
        F.when(F.col("starts_in"), F.col("open_in")).otherwise(F.col("open_out")).alias("opens"))


def _combined(found: DataFrame) -> DataFrame:
    """Split functions (``file``, ``block``, ``from_out``, ``from_in``) with every split's true ``starts_in``."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    # a split either fixes the state at its end, or keeps it, or turns it round
    fixes, turns = F.col("from_out") == F.col("from_in"), F.col("from_out") & ~F.col("from_in")
    rows = found.withColumn("n", F.sum(turns.cast("int")).over(upto))
    last = F.last(F.when(fixes, F.struct(F.col("from_out").cast("int").alias("state"), "n")), ignorenulls=True).over(before)
    rows = rows.withColumn("last", last).withColumn("turned", F.coalesce(F.sum(turns.cast("int")).over(before), F.lit(0)))
    start = (F.coalesce("last.state", F.lit(0)) + F.col("turned") - F.coalesce("last.n", F.lit(0))) % 2 == 1
    return rows.withColumn("starts_in", start).drop("n", "last", "turned")


class _Side:
    """The records of a split under one assumption about its start."""

    def __init__(self, assumed: bool):
        self.assumed: bool | None = assumed
        self.inside, self.part, self.lines, self.start = assumed, "head" if assumed else "whole", [], None

    def feed(self, line: int, value: bytes):
        if self.start is None:
            self.start = line
        self.lines.append(value)
        self.inside = ends_inside(value, self.inside)
        return None if self.inside else self.take(self.part)

    def take(self, part: str) -> tuple:
        out = (self.assumed, part, self.start, b"\n".join(self.lines))
        self.part, self.lines, self.start = "whole", [], None
        return out

    def rest(self):
        """What the split leaves open: the start of a record, or the middle of one."""
        return self.take("tail" if self.part == "whole" else "middle") if self.lines else None


def _left(at, sides: list[_Side]) -> list[tuple]:
    """What the sides leave open, and the split's function as two parts ``end`` (line 1: inside)."""
    if not sides:
        return []
    ends = [(state, "end", int(side.inside), b"") for state, side in zip((False, True), (sides[0], sides[-1]), strict=True)]
    return [(*at, *got) for got in [*(s.rest() for s in sides), *ends] if got]


_PARTS = "file string, block long, assumed boolean, part string, line long, value binary"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, sides, out = None, [], []

    def batch_of(rows):
        columns = list(zip(*rows, strict=True))
        types = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                          names=[c.split()[0] for c in _PARTS.split(", ")])

    for batch in batches:
        for file, block, line, value in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (file, block) != at:
                out += _left(at, sides)
                at, sides = (file, block), [_Side(False), _Side(True)]
            out += [(*at, *got) for s in sides if (got := s.feed(line, value))]
            if len(sides) == 2 and not sides[0].inside and not sides[1].inside:
                sides = [sides[0]]
                sides[0].assumed = None  # the same from here on
        if out:
            yield batch_of(out)
            out = []
    out += _left(at, sides)
    if out:
        yield batch_of(out)


def assembled(lines: DataFrame) -> DataFrame:
    """The records of ``lines`` (whole splits, in order; see :func:`raw_lines`): ``value``, ``file``,
    ``block``, ``line``, with the line breaks inside quoted values as they are in the file. Parts and split functions
    are written in one reading: how a file is split depends on the files read with it and on the cores at hand, so
    states of one reading say nothing about the splits of another."""
    parts = written(lines.select("file", "block", "line", "value").mapInArrow(_assemble, _PARTS), "csv-parts")
    ends = parts.where("part = 'end'").groupBy("file", "block").agg(
        F.bool_or(~F.col("assumed") & (F.col("line") == 1)).alias("from_out"),
        F.bool_or(F.col("assumed") & (F.col("line") == 1)).alias("from_in"))
    starts = _combined(ends).select("file", "block", "starts_in")
    true = parts.where("part <> 'end'").join(starts, ["file", "block"]).where(
        F.col("assumed").isNull() | (F.col("assumed") == F.col("starts_in")))
    whole = true.where("part = 'whole'").select("value", "file", "block", "line")
    order = F.struct("block", F.when(F.col("part") == "tail", 1).otherwise(0).alias("place"))
    number = F.sum(F.when(F.col("part") == "tail", 1).otherwise(0)).over(
        Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    pieces = true.where("part <> 'whole'").select("file", order.alias("place"), "line", "value", number.alias("number"))
    pieces = pieces.groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("place", "line", "value"))).alias("all"))
    sewn = pieces.select(
        F.aggregate(F.slice("all", 2, F.size("all")), F.col("all")[0]["value"],
                    lambda acc, p: F.concat(acc, F.lit(b"\n"), p["value"])).alias("value"),
        "file", F.col("all")[0]["place"]["block"].alias("block"), F.col("all")[0]["line"].alias("line"))
    return whole.unionByName(sewn)


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All records of the files, as :func:`assembled`. Files in which no value goes on after a line end
    are their lines. Raises ValueError where a file ends inside a quoted value."""
    lines = raw_lines(spark, paths)
    states = splits(lines).checkpoint()
    last = states.groupBy("file").agg(F.max_by("ends_in", "block").alias("ends_in"), F.bool_or("opens").alias("opens"))
    broken = last.where("ends_in").select("file").take(1)
    if broken:
        raise ValueError(f"file ends inside a quoted value: {broken[0]['file']}")
    opened = last.where("opens").select("file").checkpoint()
    names = [r["file"] for r in opened.collect()]  # names only; the reader lists every file as well
    if not names:
        return lines
    again = raw_lines(spark, [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(n)) for n in names])
    return lines.join(opened, "file", "left_anti").unionByName(assembled(again))
