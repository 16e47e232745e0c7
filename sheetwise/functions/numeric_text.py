"""Reading numbers written as text (currency, thousands separators, percent,
accounting negatives) and yes/no text, as pure column expressions (no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Symbol and word tables and the null/boolean tokens must equal the reference's.
# Symbols are tried in this order; words longest first (ties keep this listed order).
# ---------------------------------------------------------------------------------------------
CURRENCY_SYMBOLS = (("$", "USD"), ("£", "GBP"), ("€", "EUR"), ("₦", "NGN"), ("¥", "JPY"), ("₹", "INR"))
CURRENCY_WORDS = (
    ("us dollars", "USD"), ("dollars", "USD"), ("dollar", "USD"), ("usd", "USD"),
    ("pounds sterling", "GBP"), ("pounds", "GBP"), ("pound", "GBP"), ("sterling", "GBP"), ("gbp", "GBP"),
    ("euros", "EUR"), ("euro", "EUR"), ("eur", "EUR"),
    ("naira", "NGN"), ("ngn", "NGN"),
    ("yen", "JPY"), ("jpy", "JPY"),
    ("rupees", "INR"), ("rupee", "INR"), ("inr", "INR"),
)
NULL_TOKENS = ("", "nan", "none", "n/a", "na", "-")
BOOLEAN_TOKENS = (("yes", True), ("no", False), ("true", True), ("false", False),
                  ("y", True), ("n", False), ("t", True), ("f", False))
# ---------------------------------------------------------------------------------------------

_WORDS_LONGEST_FIRST = sorted(CURRENCY_WORDS, key=lambda kv: -len(kv[0]))
_ANY_WORD = r"(?i)\b(" + "|".join(w.replace(" ", r"\ ") for w, _ in _WORDS_LONGEST_FIRST) + r")\b"
# A plain decimal number, optionally signed, optionally with an exponent. try_cast alone would
# also accept '1d', 'NaN' or 'Infinity'.
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


# The characters Python's str.strip() removes (Unicode whitespace).
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
              "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip_ws(c: Column) -> Column:
    """Trim Unicode whitespace on both ends (plain ``trim`` only removes spaces); a character
    set scan, no regex."""
    return F.trim(c.cast("string"), F.lit(WHITESPACE))


def _word_re(word: str) -> str:
    """Case-insensitive whole-word pattern of one currency word."""
    return r"(?i)\b" + word.replace(" ", r"\ ") + r"\b"


def with_numeric_parse(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Add, for every ``src -> out`` in ``cols``, a column ``out`` of type
    ``struct<value double, currency string, is_percent boolean>`` reading ``src`` as a number.

    Empty or null-like text gives a NULL value. The first listed currency symbol present is
    removed (every occurrence); otherwise, when the text has letters, the longest currency word
    found on word boundaries is. '%' flags a percentage; '%' and ',' are dropped; '(x)' reads as
    '-x'. A value is a number only when the rest is a plain decimal.

    Built as a few staged projections: a stage result used several times by the next stage is
    not inlined by the optimizer, which keeps each generated method small."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    tmp = {src: f"__nt{i}" for i, src in enumerate(cols)}
    # stage 1: trimmed text
    df = df.select(*keep, *[strip_ws(F.col(f"`{src}`")).alias(f"{t}_s") for src, t in tmp.items()])
    # stage 2: null-like flag, currency symbol, matched currency word
    sym_to_text = F.create_map(*[x for sym, code in CURRENCY_SYMBOLS for x in (F.lit(code), F.lit(sym))])
    st2 = []
    for t in tmp.values():
        s = F.col(f"{t}_s")
        sym = F.lit(None).cast("string")
        for symbol, code in reversed(CURRENCY_SYMBOLS):
            sym = F.when(s.contains(symbol), F.lit(code)).otherwise(sym)
        word = F.lit(None).cast("string")
        for w, _ in reversed(_WORDS_LONGEST_FIRST):
            word = F.when(s.rlike(_word_re(w)), F.lit(w)).otherwise(word)
        # one combined test first: the per-word chain (longest word wins) only runs on values
        # that contain some currency word at all
        st2 += [((F.length(s) <= 4) & F.lower(s).isin(*NULL_TOKENS)).alias(f"{t}_null"),
                sym.alias(f"{t}_sym"),
                F.when(s.rlike("[A-Za-z]") & s.rlike(_ANY_WORD), word).alias(f"{t}_word")]
    df = df.select("*", *st2)
    # stage 3: text without the currency marker; currency code
    word_to_code = F.create_map(*[x for w, code in CURRENCY_WORDS for x in (F.lit(w), F.lit(code))])
    st3 = []
    for t in tmp.values():
        s, sym, word = F.col(f"{t}_s"), F.col(f"{t}_sym"), F.col(f"{t}_word")
        word_pat = F.concat(F.lit(r"(?i)\b"), F.regexp_replace(word, " ", r"\\ "), F.lit(r"\b"))
        rest = (F.when(sym.isNotNull(), F.replace(s, F.element_at(sym_to_text, sym), F.lit("")))
                 .when(word.isNotNull(), F.regexp_replace(s, word_pat, F.lit("")))
                 .otherwise(s))
        code = F.coalesce(sym, F.element_at(word_to_code, word))
        st3 += [rest.alias(f"{t}_r"), code.alias(f"{t}_cur")]
    df = df.select("*", *st3)
    # stage 4: percent flag, separators dropped
    df = df.select("*", *[x for t in tmp.values() for x in (
        F.col(f"{t}_r").contains("%").alias(f"{t}_pct"),
        strip_ws(F.translate(F.col(f"{t}_r"), "%,", "")).alias(f"{t}_r2"))])
    # stage 5: accounting negatives, strict number check, the struct
    out = []
    for src, t in tmp.items():
        r2 = F.col(f"{t}_r2")
        r3 = F.when(r2.startswith("(") & r2.endswith(")"), F.concat(F.lit("-"), _middle(r2))).otherwise(r2)
        value = F.when(r3.rlike(_NUMBER), r3.try_cast("double"))
        blank = F.col(f"`{src}`").isNull() | F.col(f"{t}_null")
        out.append(F.when(blank, F.struct(F.lit(None).cast("double").alias("value"),
                                          F.lit(None).cast("string").alias("currency"),
                                          F.lit(False).alias("is_percent")))
                    .otherwise(F.struct(value.alias("value"), F.col(f"{t}_cur").alias("currency"),
                                        F.col(f"{t}_pct").alias("is_percent")))
                    .alias(cols[src]))
    return df.select(*keep, *out)


def _middle(s: Column) -> Column:
    """``s`` without its first and last character, then trimmed."""
    return strip_ws(F.substring(s, F.lit(2), F.length(s) - 2))


def normalise_bool_text(c: Column) -> Column:
    return F.lower(strip_ws(c))


def bool_tokens() -> list[str]:
    return [k for k, _ in BOOLEAN_TOKENS]


def parse_bool_text(c: Column) -> Column:
    """Mapped boolean of a yes/no-style value, NULL for anything else."""
    lookup = F.create_map(*[x for k, v in BOOLEAN_TOKENS for x in (F.lit(k), F.lit(v))])
    return F.element_at(lookup, normalise_bool_text(c))
