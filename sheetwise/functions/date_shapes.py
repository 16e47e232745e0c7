"""Dates written in forms that no fixed pattern lists (C7, T1, T2): the form is inferred from the values.

The *shape* of a text is its character classes: every digit as ``9``, names of months ``B``, of weekdays ``W``, am/pm
``P``, UTC markers ``Z``, fractions of a second ``F``; separators stay (``3rd of March, 2020 5:07 pm`` is ``9 B, 9999
9:99 P``). One aggregate counts, for every shape, its rows and how many of its n-th numbers are at most 12 and at
most 31. A *layout*, the part of a date that each number of a shape holds, is derived from the shape's
structure; where several fit (``99/99/99``), the counts of the whole column decide. Values are then built from
their numbers by Spark functions, without a parse that could fail. Shapes that hold no date are reported with
their counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.functions.dates import as_timestamp, parse_timestamp

#: Names and marks in dates (English, and the East Asian signs for year, month, day, hour, minute, second).
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
          "december")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
EAST_ASIAN = "年月日時分秒"
#: Longer texts are not looked at: no date with its time and zone is as long.
MAX_LENGTH = 60
#: Two-digit years from this on are of the last century.
PIVOT = 69
#: Tables of shapes up to so many rows are broadcast to the values; larger ones are joined by a shuffle.
MAX_BROADCAST_SHAPES = 10_000
#: Orders of day, month and year that the counts decide between, the first of equals wins.
ORDERS = ("mdy", "dmy", "ymd")

_MONTH = "(?<![a-z])(" + "|".join([*MONTHS, "sept", *(m[:3] for m in MONTHS)]) + r")(?![a-z])\.?"
_WEEKDAY = "(?<![a-z])(" + "|".join([*WEEKDAYS, "tues", "thurs", "thur", *(d[:3] for d in WEEKDAYS)]) + r")(?![a-z])\.?"
_HALF = r"(?<![a-z])([ap])\.?m(?![a-z])\.?"


def _spaced(c: Column) -> Column:
    """Lower case, packed dates (``20200105``, ``20200105103000``) with separators, small words left out."""
    s = F.trim(F.lower(c.cast("string")))
    s = F.regexp_replace(s, r"(?<![0-9])([0-9]{4})([0-9]{2})([0-9]{2})[t ]?([0-9]{2})([0-9]{2})([0-9]{2})(?![0-9])",
                         "$1-$2-$3 $4:$5:$6")
    s = F.regexp_replace(s, r"^([0-9]{4})([0-9]{2})([0-9]{2})(?![0-9])", "$1-$2-$3")
    s = F.regexp_replace(s, r"(:[0-9]{2}(?:[.,][0-9]+)? ?[+-][0-9]{2})([0-9]{2})$", "$1:$2")
    s = F.regexp_replace(s, r"(?<=[0-9])(st|nd|rd|th)(?![a-z])", "")
    s = F.regexp_replace(s, r"(?<![a-z])(of|the|at|on)(?![a-z])", " ")
    return F.regexp_replace(F.regexp_replace(s, r"(?<=[0-9])t(?=[0-9])", " "), r"\s+", " ")


def _shape(spaced: Column) -> Column:
    s = F.regexp_replace(spaced, _MONTH, "B")
    s = F.regexp_replace(s, _WEEKDAY, "W")
    s = F.regexp_replace(s, _HALF, "P")
    s = F.regexp_replace(s, r"(?<![a-z])(utc|gmt|z)(?![a-z])", "Z")
    s = F.regexp_replace(s, r"(?<=[:分][0-9]{1,2})[.,][0-9]{1,9}", ".F")
    return F.regexp_replace(s, "[0-9]", "9")


_PARTS = "struct<spaced:string,shape:string,numbers:array<string>,month:string,half:string>"


def _parts(c: Column) -> Column:
    """Shape, numbers, month's name and am/pm mark of a text; NULL where it cannot be a date."""
    text = F.trim(c.cast("string"))
    maybe = F.length(text).between(4, MAX_LENGTH) & text.rlike("[0-9]")

    def take(spaced: Column) -> Column:
        return F.struct(spaced.alias("spaced"), _shape(spaced).alias("shape"),
                        F.regexp_extract_all(spaced, F.lit("([0-9]+)"), 1).alias("numbers"),
                        F.regexp_extract(spaced, _MONTH, 1).alias("month"), F.regexp_extract(spaced, _HALF, 1).alias("half"))

    parts = F.when(maybe, F.transform(F.array(_spaced(c)), take)[0])
    allowed = rf"^[9BWPZF ,./:+\-()'{EAST_ASIAN}]*$"
    return F.when(parts["shape"].rlike(allowed), parts)


_TIME = re.compile(r"(9{1,2})(?:[:時](9{1,2})(?:[:分](9{1,2})(?:\.(F))?)?[分秒]?)?(?: ?(P))?")
_ZONE = re.compile(r" ?(?:Z|Z?([+-])(9{2}):(9{2})|Z?([+-])(9{1,2}))$")


def layouts(shape: str) -> list[str]:
    """The layouts that fit a shape, best first; none when it holds no date.

    A layout has a letter for every number: ``y m d H M S F`` and ``h n`` (hours and minutes of a zone); after a bar
    ``B`` for a month's name, ``P`` for am/pm, ``+`` or ``-`` for the zone's sign.
    """
    rest, marks, zone = shape, "", ""
    time = next((t for t in _TIME.finditer(rest) if (t[2] or t[5]) and rest[t.start() - 1:t.start()] not in ("9", ":")), None)
    if time:
        after = rest[time.end():]
        found = _ZONE.search(after)
        if found and not after[:found.start()].strip(" ,"):
            after = ""
            if found[1]:
                zone, marks = "hn", found[1]
            elif found[4]:
                zone, marks = "h", found[4]
        before = rest[:time.start()]
        if before.strip() and after.strip(" ,)"):
            return []  # something on both sides of the time
        clock = "H" + ("M" if time[2] else "") + ("S" if time[3] else "") + ("F" if time[4] else "")
        marks += "P" if time[5] else ""
        rest = before if before.strip() else after
        clock_first = not before.strip()
    else:
        clock, clock_first = "", False
    if rest.count("W") > 1:
        return []
    rest = rest.replace("W", " ").strip(" ,()")
    if re.search(rf"[^9B ,./\-'{EAST_ASIAN[:3]}]", rest):
        return []
    numbers = re.findall("9+", rest)
    between = [x.strip(" ,") for x in re.split("9+|B", rest)]
    if any(len(x) > 1 for x in between) or any(x in "-./'" and x for x in (between[0], between[-1])):
        return []
    wide = [i for i, n in enumerate(numbers) if len(n) == 4]
    small = [i for i, n in enumerate(numbers) if len(n) <= 2]
    if len(wide) + len(small) < len(numbers) or len(wide) > 1:
        return []
    if rest.count("B") == 1:
        marks += "B"
        if len(numbers) == 1 and wide:
            dates = ["y"]
        elif len(numbers) == 2 and wide:
            dates = ["yd" if wide[0] == 0 else "dy"]
        elif len(numbers) == 2 and len(numbers[1]) == 2 and not rest.endswith("B"):
            dates = ["dy"]
        else:
            return []
    elif "B" in rest:
        return []
    elif len(numbers) == 3 and (wide == [0] or "年" in rest):
        dates = ["ymd"] if "年" not in rest or re.fullmatch(r"9+ ?年 ?9+ ?月 ?9+ ?日?", rest) else []
    elif len(numbers) == 3 and wide == [2]:
        dates = ["mdy", "dmy"]
    elif len(numbers) == 3 and not wide:
        dates = [o for o in ORDERS if len(numbers[o.index("y")]) == 2]
    elif len(numbers) == 2 and len(wide) == 1 and between[1] in tuple("-/年"):
        dates = ["ym" if wide == [0] else "my"]
    else:
        return []
    return ["|".join((clock + zone + d if clock_first else d + clock + zone, marks)) for d in dates]


def date_shapes(df: DataFrame, cols: Iterable[str], unread_only: bool = True, day_first: bool = False,
                rows: str | None = None) -> DataFrame:
    """``column, shape, n, small, middling``: the shapes of the text columns ``cols`` with their rows, and for every
    number of a shape how often it is at most 12 and at most 31. Texts that cannot be dates have shape NULL; NULL
    texts are not counted. ``unread_only`` leaves out what the fixed patterns read. ``rows`` names a column with the
    number of rows that a text stands for. One aggregate for all columns;
    equal shapes are summed before the shuffle."""
    cols = list(cols)
    weight = F.lit(1) if rows is None else F.col(f"`{rows}`")
    texts = df.select(weight.cast("long").alias("w"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("text"))
                                          for c in cols])).alias("x")).select("w", "x.column", "x.text").where("text IS NOT NULL")
    if unread_only:
        texts = texts.where(parse_timestamp(F.col("text"), day_first).isNull())
    long = texts.select("w", "column", _parts(F.col("text")).alias("p")).select(
        "w", "column", F.col("p.shape").alias("shape"), F.posexplode_outer("p.numbers").alias("at", "number"))
    value = F.col("number").try_cast("int")
    counts = long.groupBy("column", "shape", "at").agg(
        F.sum("w").alias("n"), F.sum(F.when(value.between(1, 12), F.col("w")).otherwise(0)).alias("small"),
        F.sum(F.when(value.between(1, 31), F.col("w")).otherwise(0)).alias("middling"))
    return counts.groupBy("column", "shape").agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "small", "middling"))).alias("by_number")).select(
        "column", "shape", "n", F.transform("by_number", lambda x: x["small"]).alias("small"),
        F.transform("by_number", lambda x: x["middling"]).alias("middling"))


def infer_layouts(shapes: DataFrame, day_first: bool = False) -> DataFrame:
    """``shapes`` (:func:`date_shapes`, written or checkpointed) with ``layout``, NULL where a shape holds no date.

    A day or month first is decided once for a column: by how many of its values, over all shapes that leave it open,
    have numbers in range for it. Of equal orders the first of :data:`ORDERS` wins (with ``day_first`` days, then months)."""
    schema = "column string, shape string, n long, layout string, order string, fits long"

    def derive(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                for layout in (layouts(r.shape) if r.shape else []) or [None]:
                    letters = layout.split("|")[0] if layout else ""
                    fits = min([int(r.small[letters.index("m")])] if "m" in letters else [int(r.n)])
                    if "d" in letters:
                        fits = min(fits, int(r.middling[letters.index("d")]))
                    order = "".join(x for x in letters if x in "dmy") if layout and "B" not in layout else ""
                    rows.append((r.column, r.shape, r.n, layout, order, fits))
            yield pd.DataFrame(rows, columns=["column", "shape", "n", "layout", "order", "fits"])

    every = shapes.mapInPandas(derive, schema)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, sorted(ORDERS, key=lambda o: o != "dmy") if day_first else ORDERS)),
                                        F.col("order")), F.lit(0))
    open_ = every.groupBy("column", "shape").agg(F.count("*").alias("ways")).where("ways > 1").drop("ways")
    votes = (every.join(open_, ["column", "shape"]).groupBy("column", "order").agg(F.sum("fits").alias("fits"))
                  .groupBy("column").agg(F.map_from_entries(F.collect_list(F.struct("order", "fits"))).alias("votes")))
    best = (every.join(votes, "column", "left")
                 .withColumn("vote", F.coalesce(F.element_at("votes", F.col("order")), F.lit(0)))
                 .groupBy("column", "shape").agg(F.max("n").alias("n"), F.max_by("layout", F.struct("vote", -rank)).alias("layout")))
    return best


def _built(parts: Column, layout: Column) -> Column:
    """The timestamp whose parts ``layout`` finds among the numbers; NULL where they are no date."""
    letters, marks = F.substring_index(layout, "|", 1), F.substring_index(layout, "|", -1)

    def number(letter: str) -> Column:
        at = F.instr(letters, letter)
        return F.when(at > 0, F.get(parts["numbers"], at - 1))

    def whole(letter: str, default: int) -> Column:
        return F.coalesce(number(letter).try_cast("int"), F.lit(default))

    year = number("y").try_cast("int")
    year = F.when(F.length(number("y")) > 2, year).otherwise(year + F.when(year >= PIVOT, 1900).otherwise(2000))
    named = F.instr(F.lit("".join(m[:3] for m in MONTHS)), F.substring(parts["month"], 1, 3))
    month = F.when(marks.contains("B"), ((named + 2) / 3).cast("int")).otherwise(whole("m", 1))
    hour = whole("H", 0)
    twelve = F.when(hour.between(1, 12), hour % 12 + F.when(parts["half"] == "p", 12).otherwise(0))
    hour = F.when(marks.contains("P"), twelve).otherwise(hour)
    micros = F.rpad(F.substring(F.coalesce(number("F"), F.lit("0")), 1, 6), 6, "0")
    second = F.concat(whole("S", 0).cast("string"), F.lit("."), micros).try_cast("decimal(16,6)")
    built = F.try_make_timestamp_ntz(year, month, whole("d", 1), hour, whole("M", 0), second)
    ahead = (whole("h", 0) * 60 + whole("n", 0)) * F.when(marks.contains("-"), -1).otherwise(1)
    return built - F.make_dt_interval(mins=ahead)


def with_dates(df: DataFrame, col: str, inferred: DataFrame, out: str, day_first: bool = False) -> DataFrame:
    """``df`` with TIMESTAMP_NTZ column ``out``: what the fixed patterns read of text column ``col``, else what the
    column's layouts (:func:`infer_layouts`, written or checkpointed) read. NULL and unreadable texts give NULL; every
    row stays once. Two-digit years are 1969 to 2068; zones are turned into UTC. The table of shapes is counted: small
    ones are broadcast."""
    known = inferred.where((F.col("column") == col) & F.col("layout").isNotNull()).select(
        F.col("shape").alias("__shape"), F.col("layout").alias("__layout"))
    listed = parse_timestamp(F.col(f"`{col}`"), day_first)
    n = known.count()
    if n == 0:
        return df.withColumn(out, listed)
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    own = "__date"
    while any(c.lower().startswith(own) for c in df.columns):
        own += "_"
    rows = df.withColumn(f"{own}_listed", listed).withColumn(
        f"{own}_parts", F.when(F.col(f"{own}_listed").isNull(), _parts(F.col(f"`{col}`"))))
    rows = rows.withColumn(f"{own}_shape", F.col(f"{own}_parts.shape"))
    known = known.withColumnsRenamed({"__shape": f"{own}_shape", "__layout": f"{own}_layout"})
    rows = rows.join(F.broadcast(known) if n <= MAX_BROADCAST_SHAPES else known, f"{own}_shape", "left")
    layout = F.col(f"{own}_layout")
    read = F.coalesce(F.col(f"{own}_listed"), F.when(layout.isNotNull(), _built(F.col(f"{own}_parts"), layout)))
    return rows.select(*keep, read.alias(out))


def has_date_shape(c: Column) -> Column:
    """Whether a text has only words and signs that dates have (cheap for texts of other characters)."""
    text = F.trim(c.cast("string"))
    signs = rf"^[0-9A-Za-z ,./:+()'{EAST_ASIAN}-]+$"
    return F.coalesce(F.when(F.length(text).between(4, MAX_LENGTH) & text.rlike(signs), _parts(c).isNotNull()), F.lit(False))


def read_dates(df: DataFrame, col: str, out: str | None = None, day_first: bool = False) -> DataFrame:
    """Text column ``col`` read as dates into ``out`` (default: in its place, then moved to the end). One pass for
    the shapes that the fixed patterns leave unread; a second reading only where there are any."""
    inferred = infer_layouts(date_shapes(df, [col], day_first=day_first).checkpoint(), day_first).checkpoint()
    return with_dates(df, col, inferred, out or col, day_first)


def with_timestamp(df: DataFrame, col: str) -> DataFrame:
    """``df`` with column ``col`` as TIMESTAMP_NTZ: timestamps pass through, dates are widened, text is read by the
    fixed patterns and by shape."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return read_dates(df, col).select(*[F.col(f"`{c}`") for c in df.columns])
    return df.withColumn(col, as_timestamp(F.col(f"`{col}`"), dtype))


def unread_shapes(df: DataFrame, col: str) -> DataFrame:
    """``shape, n`` of the texts of ``col`` that hold no date, most frequent first; shape NULL counts texts that
    have other words or signs than dates have. Values out of range (month 13) belong to a shape that holds dates and
    are not listed."""
    inferred = infer_layouts(date_shapes(df, [col]).checkpoint())
    return inferred.where("layout IS NULL").select("shape", "n").orderBy(F.desc("n"), "shape")
