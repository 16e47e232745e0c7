"""Cleaning and type recovery: C1 duplicates, C3/C5/C6 numeric and yes/no text detection,
C7 dates, C8 missing profile, C9-C11 fills, C12 the whole ``clean``.

Plan: NaN -> NULL, a group-by on all columns with a row count (hash aggregate with map-side
combine: a hot repeated row collapses inside each task before the shuffle; the input row count is
the sum of the counts), written as Parquet; then

1. a table of the text columns' distinct values with their rows (one unpivot and grouped count, written):
   numbers, yes/no words, dates and modes are read from it, so an equal value is tried against the patterns
   once for all its rows, and columns without repeats cost one more shuffle;
2. counts of the other columns, then the typed table (numbers parsed once, written);
3. boolean counts and medians on the typed table, date counts and text modes on the values;
4. one final ``select`` that fills and parses dates.

Only per-column scalars reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.functions import naming as N
from sheetwise.functions.date_shapes import date_shapes, has_date_shape, infer_layouts, with_dates
from sheetwise.functions.dates import date_reading_flags, parse_timestamp
from sheetwise.functions.missing import nan_to_null
from sheetwise.functions.numeric_text import (bool_tokens, normalise_bool_text, parse_bool_text,
                                              with_numeric_parse)
from sheetwise.functions.quantiles import column_quantiles
from sheetwise.session import written

NUMERIC_SHARE = 0.7   # share of non-NULL values that must read as numbers
DATE_SHARE = 0.7      # share of values that must read as dates (strictly more)
UNKNOWN = "Unknown"   # text fill when a column has no value at all


def _q(c: str):
    return F.col(f"`{c}`")


def distinct_rows_counted(df: DataFrame, name: str = "__dup_n") -> DataFrame:
    """The distinct rows of ``df`` plus ``name``: how many input rows each stands for. One
    grouped aggregate on all columns - the same shuffle as ``dropDuplicates``, with map-side
    combining - so the input row count comes for free as the sum of ``name``. Map columns (Spark
    cannot group on maps) take part in the key as their entries sorted by key, so rows are equal
    exactly when every value, map contents included, is equal."""
    maps = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    if not maps:
        return df.groupBy(*[_q(c) for c in df.columns]).agg(F.count("*").alias(name))
    keyed = df.select("*", *[F.array_sort(F.map_entries(_q(m))).alias(f"__mk{i}") for i, m in enumerate(maps)])
    subset = [c for c in df.columns if c not in maps] + [f"__mk{i}" for i in range(len(maps))]
    grouped = keyed.groupBy(*[_q(c) for c in subset]).agg(*[F.first(_q(m)).alias(m) for m in maps],
                                                            F.count("*").alias(name))
    return grouped.select(*[_q(c) for c in df.columns], name)


def drop_duplicates(df: DataFrame) -> tuple[DataFrame, int, int]:
    """Whole-row duplicates removed (NULLs equal). Returns (table, rows before, removed).
    One pass over the input: the de-duplicating aggregate also counts the rows it collapses."""
    counted = distinct_rows_counted(df).checkpoint()
    r = counted.agg(F.count("*").alias("after"), F.coalesce(F.sum("__dup_n"), F.lit(0)).alias("before")).first()
    return counted.drop("__dup_n"), int(r["before"]), int(r["before"] - r["after"])


def convert_column_types(df: DataFrame, accuracy="auto", _profile=None) -> tuple[DataFrame, dict]:
    """Text columns to boolean (C5) or number (C3), renaming ``X (CODE)`` for a single
    currency, else ``X (%)`` when any value had '%'. Identifier-named columns skip the numeric
    step. Returns (converted table, report with ``currency_columns_converted``,
    ``percent_columns_converted``, ``boolean_columns_converted``)."""
    prof = _profile or _profile_pass(df)
    return _apply_types(df, prof), prof["report"]


def _parse_map(df: DataFrame) -> dict[str, str]:
    """Text columns that may hold numbers (identifier names skip) -> their parse column."""
    text = N.text_columns(df, include_internal=True)
    return {c: f"__p{i}" for i, c in enumerate(text) if not N.has_identifier_name(c)}


def _value_aggs(v, parsed, i, parses: bool, weight=None) -> list:
    """Aggregates of text values ``v``: yes/no words and, with ``parses``, numbers read as ``parsed``."""
    norm = F.when(v.isNotNull(), normalise_bool_text(v))
    aggs = [F.bool_and(norm.isin(*bool_tokens())).alias(f"ball{i}"), F.min(norm).alias(f"bmin{i}"),
            F.max(norm).alias(f"bmax{i}")]
    if parses:
        read = parsed["value"]
        ok = F.count(read) if weight is None else F.coalesce(F.sum(F.when(read.isNotNull(), weight)), F.lit(0))
        aggs += [ok.alias(f"ok{i}"), F.collect_set(parsed["currency"]).alias(f"cur{i}"),  # at most six codes
                 F.bool_or(parsed["is_percent"]).alias(f"pct{i}")]
    return aggs


def _profile_pass(df: DataFrame) -> dict:
    """One aggregate over every column."""
    text = N.text_columns(df, include_internal=True)
    parse_map = _parse_map(df)
    parsed = with_numeric_parse(df, parse_map) if parse_map else df
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(_q(c)).alias(f"n{i}"))
        if c in text:
            aggs += _value_aggs(_q(c), F.col(parse_map[c]) if c in parse_map else None, i, c in parse_map)
    return _decided(df, text, parse_map, parsed.agg(*aggs).first().asDict())


def _value_counts(df: DataFrame, text: list[str]) -> DataFrame:
    """``k, v, n``: every distinct non-NULL value of the text columns (``k``: its place in ``df``) with its rows."""
    at = {c: i for i, c in enumerate(df.columns)}
    pairs = F.explode(F.array(*[F.struct(F.lit(at[c]).alias("k"), _q(c).cast("string").alias("v")) for c in text]))
    return (df.select(pairs.alias("x")).select("x.k", "x.v").where("v IS NOT NULL")
              .groupBy("k", "v").agg(F.count("*").alias("n")))


def _profile_values(counted: DataFrame, df: DataFrame, values: DataFrame | None) -> dict:
    """The profile of ``df`` (``counted`` without ``__dup_n``), its text columns from their distinct values."""
    text, parse_map = N.text_columns(df, include_internal=True), _parse_map(df)
    aggs = [F.count("*").alias("rows"), F.coalesce(F.sum("__dup_n"), F.lit(0)).alias("input_rows")]
    row = counted.agg(*aggs, *[F.count(_q(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first().asDict()
    places = {i for i, c in enumerate(df.columns) if c in text}
    found = {}
    if values is not None:
        # identifiers skip the numeric reading
        ids = [i for i in places if df.columns[i] not in parse_map]
        rows = values.withColumn("read", F.when(~F.col("k").isin(*ids), F.col("v")).otherwise(F.lit(None))) if ids else \
            values.withColumn("read", F.col("v"))
        parsed = with_numeric_parse(rows, {"read": "p"})
        found = {r["k"]: r.asDict() for r in parsed.groupBy("k").agg(
            *_value_aggs(F.col("v"), F.col("p"), "", True, F.col("n"))).collect()}  # one row a column
    for i in places:
        for name in ("ball", "bmin", "bmax", "ok", "cur", "pct"):
            row[f"{name}{i}"] = found.get(i, {}).get(name)
    return _decided(df, text, parse_map, row)


def _decided(df: DataFrame, text: list[str], parse_map: dict[str, str], row: dict) -> dict:
    idx = {c: i for i, c in enumerate(df.columns)}
    rows = row["rows"]
    kinds, names, nonnull = {}, {}, {}
    currency_cols, percent_cols, boolean_cols = {}, [], []
    for c, i in idx.items():
        n = row[f"n{i}"]
        kinds[c], names[c], nonnull[c] = "keep", c, n
        if c not in text or n == 0:
            continue
        if row[f"ball{i}"] and row[f"bmin{i}"] != row[f"bmax{i}"]:
            kinds[c] = "bool"
            boolean_cols.append(c)
            continue
        if c not in parse_map:
            continue
        ok = row[f"ok{i}"]
        if ok / n >= NUMERIC_SHARE:
            kinds[c] = "num"
            nonnull[c] = ok
            codes = row[f"cur{i}"] or []
            if len(codes) == 1:
                names[c] = f"{c} ({codes[0]})"
                currency_cols[c] = names[c]
            elif row[f"pct{i}"]:
                names[c] = f"{c} (%)"
                percent_cols.append(names[c])
    return {"rows": rows, "input_rows": row.get("input_rows", rows),
            "kinds": kinds, "names": names, "nonnull": nonnull,
            "parse_map": parse_map,
            "report": {"currency_columns_converted": currency_cols,
                       "percent_columns_converted": percent_cols,
                       "boolean_columns_converted": boolean_cols}}


def _apply_types(df: DataFrame, prof: dict) -> DataFrame:
    nums = {c: prof["parse_map"][c] for c, k in prof["kinds"].items() if k == "num"}
    base = with_numeric_parse(df, nums) if nums else df
    sel = []
    for c in df.columns:
        k, name = prof["kinds"][c], prof["names"][c]
        if k == "bool":
            sel.append(parse_bool_text(_q(c)).alias(name))
        elif k == "num":
            sel.append(F.col(nums[c])["value"].alias(name))
        else:
            sel.append(_q(c).alias(name))
    return base.select(*sel)


def clean(df: DataFrame, accuracy="auto", persist: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """Duplicates (C1) -> type recovery (C6) -> missing profile (C8) -> fills (C9 median,
    C10 text mode or 'Unknown', C11 boolean mode) -> dates (C7, on text columns after the fills).

    Returns ``(cleaned, report_df, report)``: the lazily defined cleaned table (on top of the
    persisted de-duplicated input), a one-row report DataFrame, and the same report as a dict
    (original/cleaned rows and columns, duplicates, missing per column, column lists)."""
    spark = df.sparkSession
    original_cols = len(df.columns)
    src = nan_to_null(df)
    keep = _kept if persist else (lambda d: d)
    # distinct rows with their multiplicity: the original row count is their sum (no extra scan)
    counted = keep(distinct_rows_counted(src))
    dedup = counted.drop("__dup_n")
    text = N.text_columns(dedup, include_internal=True)
    values = keep(_value_counts(dedup, text)) if text else None
    prof = _profile_values(counted, dedup, values)
    rows = prof["rows"]
    original_rows = prof["input_rows"]
    typed = _apply_types(dedup, prof)
    if "num" in prof["kinds"].values():  # read by every pass of the medians: parsed once
        typed = keep(typed)
    names = prof["names"]

    # NULLs after type recovery.
    missing = {}
    for c in dedup.columns:
        miss = rows - prof["nonnull"][c]
        if miss > 0:
            missing[names[c]] = miss
    fields = {f.name: f.dataType for f in typed.schema.fields}
    num_cols = [n for n, t in fields.items() if isinstance(t, N.NUMERIC_TYPES)]
    cat_cols = [n for n, t in fields.items() if isinstance(t, N.TEXT_TYPES)]
    bool_cols = [n for n, t in fields.items() if isinstance(t, T.BooleanType)]
    orig_of = {v: k for k, v in names.items()}

    # Pass 2: medians (exact, by narrowing brackets), boolean counts, date parse counts.
    aggs = []
    need_median = [c for c in num_cols if missing.get(c, 0) > 0 and prof["nonnull"][orig_of[c]] > 0]
    for j, c in enumerate(bool_cols):
        if missing.get(c, 0) > 0:
            aggs += [F.count_if(_q(c)).alias(f"bt{j}"), F.count_if(~_q(c)).alias(f"bf{j}")]
    stats = typed.agg(*aggs).first().asDict() if aggs else {}
    place = {c: dedup.columns.index(orig_of[c]) for c in cat_cols}
    dates = _date_counts(values, list(place.values())) if cat_cols else {}

    fills: dict[str, object] = {}
    for c, q in column_quantiles(typed.select(*[_q(c) for c in need_median]), need_median, [0.5], accuracy).items():
        if q[0] is not None:
            fills[c] = float(q[0])
    for j, c in enumerate(bool_cols):
        if missing.get(c, 0) > 0:
            t_, f_ = stats[f"bt{j}"], stats[f"bf{j}"]
            if t_ + f_ > 0:
                fills[c] = bool(t_ > f_)  # ties go to False, the smaller value
    need_mode = [c for c in cat_cols if missing.get(c, 0) > 0]
    modes = _value_modes(values, {place[c]: c for c in need_mode})
    for c in need_mode:
        fills[c] = modes.get(c, UNKNOWN)

    # Date decision on the filled text columns.
    fill_parse = {}
    text_fills = [c for c in cat_cols if c in fills]
    if text_fills:
        probe = spark.range(1).select(*[x for k, c in enumerate(text_fills) for x in (
            parse_timestamp(F.lit(fills[c]), False).isNotNull().alias(f"m{k}"),
            parse_timestamp(F.lit(fills[c]), True).isNotNull().alias(f"d{k}"))]).first()
        fill_parse = {c: (probe[f"m{k}"], probe[f"d{k}"]) for k, c in enumerate(text_fills)}
    date_cols: dict[str, bool] = {}
    shaped: dict[str, DataFrame] = {}
    for c in cat_cols:
        if rows == 0:
            continue
        extra = missing.get(c, 0)
        found = dates.get(place[c], {"mf": 0, "df": 0, "odd": 0})
        mf = found["mf"] + (extra if fill_parse.get(c, (False, False))[0] else 0)
        dfc = found["df"] + (extra if fill_parse.get(c, (False, False))[1] else 0)
        day_first = dfc > mf
        read = max(mf, dfc)
        # values of other forms: their layouts are inferred where they could make or complete a date column
        odd = found["odd"]
        if odd and (read + odd + (extra if c in fills else 0)) / rows > DATE_SHARE:
            # the column's values after the fills, with their rows
            filled = F.when(F.col("v") == F.lit(fills[c]), F.lit(extra)).otherwise(F.lit(0)) if c in fills else F.lit(0)
            texts = values.where(F.col("k") == place[c]).select(F.col("v").alias(c), (F.col("n") + filled).alias("__n"))
            layouts = infer_layouts(date_shapes(texts, [c], day_first=day_first, rows="__n").checkpoint(),
                                    day_first).checkpoint()
            if not layouts.where("layout IS NOT NULL").isEmpty():
                shaped[c] = layouts
                read = with_dates(texts, c, layouts, "__read", day_first).agg(
                    F.coalesce(F.sum(F.when(F.col("__read").isNotNull(), F.col("__n"))), F.lit(0))).first()[0]
        if read / rows > DATE_SHARE:
            date_cols[c] = day_first

    out = []
    for c in typed.columns:
        e = _q(c)
        if c in fills:
            e = F.coalesce(e, F.lit(fills[c]))
        if c in date_cols and c not in shaped:
            e = parse_timestamp(e, date_cols[c])
        out.append(e.alias(c))
    cleaned = typed.select(*out)
    for c in shaped:
        if c in date_cols:
            cleaned = with_dates(cleaned, c, shaped[c], c, date_cols[c]).select(*[_q(n) for n in typed.columns])

    report = {
        "original_rows": int(original_rows), "original_cols": original_cols,
        "duplicates_removed": int(original_rows - rows),
        **prof["report"],
        "missing_by_col": missing, "total_missing": int(sum(missing.values())),
        "cleaned_rows": int(rows), "numeric_cols": num_cols, "categorical_cols": cat_cols,
        "boolean_cols": bool_cols, "date_cols": list(date_cols),
    }
    return cleaned, report_frame(spark, report), report


def _kept(df: DataFrame) -> DataFrame:
    """``df`` kept in the cluster's checkpoint folder: as Parquet, so that a pass reads only its columns, or as a
    checkpoint where it has types that Parquet has not."""
    if any(word in f.dataType.simpleString() for f in df.schema.fields for word in ("void", "interval", "variant")):
        return df.checkpoint()
    plain = written(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), "clean")  # any names
    return plain.toDF(*df.columns)


def _date_counts(values: DataFrame, places: list[int]) -> dict[int, dict]:
    """For the columns ``places``: rows read month first (``mf``) and day first (``df``) by the fixed patterns,
    and rows of other forms that may hold dates (``odd``). Each distinct value is read once."""
    shared, mf, dfo = date_reading_flags(F.col("v"))
    rows = values.where(F.col("k").isin(*places)).select("*", shared.alias("s"), mf.alias("m"), dfo.alias("d"))
    rows = rows.withColumn("o", F.when(~(F.col("s") | F.col("m") | F.col("d")), has_date_shape(F.col("v"))))
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return {r["k"]: r.asDict() for r in rows.groupBy("k").agg(
        total(F.col("s") | F.col("m")).alias("mf"), total(F.col("s") | F.col("d")).alias("df"),
        total(F.col("o")).alias("odd")).collect()}  # one row a column


def _value_modes(values: DataFrame, names: dict[int, str]) -> dict[str, str]:
    """Most frequent value per column, the smallest on ties, of counted values."""
    if not names:
        return {}
    w = Window.partitionBy("k").orderBy(F.col("n").desc(), F.col("v").asc())
    top = values.where(F.col("k").isin(*names)).withColumn("r", F.row_number().over(w)).where(F.col("r") == 1).collect()
    return {names[r["k"]]: r["v"] for r in top}


def text_modes(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """Most frequent non-NULL value per column, the smallest on ties. One unpivot, one
    grouped count (map-side combined), one top-1 per column (the window group limit keeps one
    row per column per task before the final shuffle)."""
    if not cols:
        return {}
    return _value_modes(_value_counts(df, cols), {df.columns.index(c): c for c in cols})


def report_frame(spark, report: dict) -> DataFrame:
    """The clean report as a one-row DataFrame."""
    schema = ("original_rows long, original_cols int, duplicates_removed long, total_missing long, "
              "cleaned_rows long, missing_by_col map<string,long>, "
              "currency_columns_converted map<string,string>, percent_columns_converted array<string>, "
              "boolean_columns_converted array<string>, numeric_cols array<string>, "
              "categorical_cols array<string>, boolean_cols array<string>, date_cols array<string>")
    r = report
    return spark.createDataFrame([(
        r["original_rows"], r["original_cols"], r["duplicates_removed"], r["total_missing"],
        r["cleaned_rows"], r["missing_by_col"], r["currency_columns_converted"],
        r["percent_columns_converted"], r["boolean_columns_converted"], r["numeric_cols"],
        r["categorical_cols"], r["boolean_cols"], r["date_cols"])], schema)
