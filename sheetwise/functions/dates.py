"""Text-to-timestamp parsing over fixed, documented format lists.

pandas guesses any format; here a value parses when one of the listed patterns reads it.
Year-first forms are shared; the two lists differ in how ``a/b/yyyy``-like values are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted date patterns (Spark datetime pattern letters), tried in this order.
YEAR_FIRST_FORMATS = (
    "yyyy-MM-dd[ HH:mm[:ss[.SSSSSS]]]",
    "yyyy-MM-dd'T'HH:mm[:ss[.SSSSSS]]",
    "yyyy-MM-dd h:mm[:ss] a",
    "yyyy/MM/dd[ HH:mm[:ss]]",
    "yyyyMMdd",
    "yyyy-M-d",
    "yyyy/M/d",
    "yyyy-MM",
    "yyyy/MM",
)
MONTH_FIRST_FORMATS = (
    "M/d/yyyy[ H:mm[:ss]]", "M/d/yyyy h:mm[:ss] a", "M-d-yyyy", "M.d.yyyy", "M/d/yy",
)
DAY_FIRST_FORMATS = (
    "d/M/yyyy[ H:mm[:ss]]", "d/M/yyyy h:mm[:ss] a", "d-M-yyyy", "d.M.yyyy", "d/M/yy",
)
MONTH_NAME_FORMATS = (
    "MMM d[,] yyyy[ HH:mm[:ss]]", "MMM d[,] yyyy h:mm[:ss] a", "MMMM d[,] yyyy",
    "d MMM yyyy[ HH:mm[:ss]]", "d MMM yyyy h:mm[:ss] a", "d MMMM yyyy", "d MMM yy",
    "MMM yyyy", "MMMM yyyy",
)
# A value fits at most one of the numeric-order groups or the month-name group, so only the
# MONTH_FIRST / DAY_FIRST choice depends on the reading order; the other patterns are shared.


def _shape(fmt: str) -> str:
    """A regex that every text readable by ``fmt`` matches: pattern letters become digit or
    letter runs of the widths Spark accepts, literals stay literal."""
    out, i = ["^"], 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "'":
            j = fmt.index("'", i + 1)
            out.append(re.escape(fmt[i + 1:j]))
            i = j + 1
            continue
        if ch in "[]":  # an optional section
            out.append("(" if ch == "[" else ")?")
            i += 1
            continue
        j = i
        while j < len(fmt) and fmt[j] == ch:
            j += 1
        n = j - i
        if ch == "M" and n >= 3:
            out.append("[A-Za-z]{3}" if n == 3 else "[A-Za-z]{3,9}")
        elif ch == "S":
            out.append("[0-9]{1,6}")
        elif ch == "a":
            out.append("[AaPp][Mm]")
        elif ch in "yMdHhms":
            out.append(f"[0-9]{{{n}}}" if n > 1 and ch != "y" or ch == "y" else "[0-9]{1,2}")
        else:
            out.append(re.escape(fmt[i:j]))
        i = j
    out.append("$")
    return "".join(out)


_ANY_SHAPE = r"^[0-9A-Za-z][0-9A-Za-z ,/.:'T+-]*[0-9][0-9A-Za-z ,/.:'T+-]*$"
#: No listed pattern, with zone and fraction, reads a text outside these lengths.
_LENGTHS = (6, 45)
_ZONE = r"(?<=:[0-9]{2}|:[0-9]{2}\.[0-9]{1,9})\s*(Z|[+-][0-9]{2}:?[0-9]{2})$"


def _plain(s: Column) -> Column:
    """A date text without its zone, with at most six digits of a second's fraction, and with spaces
    around a month's name (``05-Jan-2020`` as ``05 Jan 2020``)."""
    s = F.regexp_replace(s, _ZONE, "")
    s = F.regexp_replace(s, r"(:[0-9]{2}\.[0-9]{6})[0-9]+$", "$1")
    return F.regexp_replace(s, r"^([0-9]{1,2})[-/.]([A-Za-z]{3,9})[-/.]([0-9]{2,4})", "$1 $2 $3")


def _zone_seconds(s: Column) -> Column:
    """The zone's distance from UTC in seconds (0 for Z or none)."""
    sign = F.when(F.regexp_extract(s, _ZONE, 1).startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(F.regexp_extract(s, _ZONE, 1), "[^0-9]", "")
    return F.when(F.length(digits) == 4, sign * (digits.substr(1, 2).cast("int") * 3600
                                                 + digits.substr(3, 2).cast("int") * 60)).otherwise(F.lit(0))


def _parse_with(s: Column, fmts) -> Column:
    # the plain form is bound once for all patterns (a one-element transform): written out in every
    # branch it would make generated methods too large to compile
    def read(plain):
        return F.coalesce(*[F.when(plain.rlike(_shape(f)), F.try_to_timestamp(plain, F.lit(f))) for f in fmts])

    return F.transform(F.array(_plain(s)), read)[0]


def _could_be_date(s: Column) -> Column:
    # one cheap test first: a text of other characters or lengths skips the per-pattern tests
    return F.length(s).between(*_LENGTHS) & s.rlike(_ANY_SHAPE)


def parse_timestamp(c: Column, day_first: bool = False) -> Column:
    """TIMESTAMP_NTZ from text, NULL when no listed pattern reads the trimmed value.

    Each pattern is only attempted on values whose shape (regex) fits it, so a value costs one
    parse, not one failed parse (an exception inside Spark) per listed pattern. A time with a zone is
    turned into UTC."""
    s = F.trim(c.cast("string"))
    fmts = YEAR_FIRST_FORMATS + (DAY_FIRST_FORMATS if day_first else MONTH_FIRST_FORMATS) + MONTH_NAME_FORMATS
    read = F.when(_could_be_date(s), _parse_with(s, fmts)).cast("timestamp_ntz")
    return read - F.make_dt_interval(secs=_zone_seconds(s))


def date_reading_flags(c: Column) -> tuple[Column, Column, Column]:
    """(reads with the shared patterns, reads month-first, reads day-first) for one text value:
    the date-detection counts evaluate the shared patterns once instead of once per order."""
    s = F.trim(c.cast("string"))
    ok = _could_be_date(s)
    shared = F.when(ok, _parse_with(s, YEAR_FIRST_FORMATS + MONTH_NAME_FORMATS)).isNotNull()
    mf = F.when(ok, _parse_with(s, MONTH_FIRST_FORMATS)).isNotNull()
    dfo = F.when(ok, _parse_with(s, DAY_FIRST_FORMATS)).isNotNull()
    return shared, mf, dfo


def as_timestamp(c: Column, dtype) -> Column:
    """Timestamp-typed columns pass through, dates are widened, text is parsed."""
    from pyspark.sql import types as T
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    return parse_timestamp(c)
