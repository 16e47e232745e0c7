"""Language identification by prediction by partial matching (PPM) over bytes.

For every language a context tree of byte n-grams is learnt: a node is a context of up to
``order`` preceding bytes, with the counts of the bytes that followed. A byte that a node has not
seen costs the node's escape (method C: distinct / (total + distinct)) and is predicted by the
next shorter context, over the bytes the node has not seen; below the empty context all bytes
are equally likely. Statistics are frozen after training, so the code length of a text under a
language is exact and is a sum of table look-ups: the trees of all languages are laid out as one
table (context node, byte) -> code length for each language.

A text's language is the one with the shortest code for the whole text. ``score`` is its posterior
probability under equal priors. The posterior compares the learnt languages only and is near 1 for any longer
text, so whether a text is in its language at all is judged by figures a byte: its code length, and the
distance to the second language, against those of labelled texts that were not learnt from (`fit_limits`).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetwise.functions.quantiles import grouped_quantiles
from sheetwise.llm.common import ROWS_AT_ONCE, map_arrow, map_column, written

ORDER = 3
UNDETERMINED = "und"
#: Bits of a text's code that do not count, whatever its length: about forty odd bytes (a key, an address, a name).
SLACK_BITS = 320.0
#: Bits that its distance to the second language may be shorter, whatever its length.
MARGIN_SLACK_BITS = 64.0
#: A text is in its language up to so many spreads from the median of the labelled texts. The spread is the distance
#: of their hundredth furthest from the median, at least the given share of the median.
SPREADS = 3.0
MIN_SPREAD = 0.25
_CHUNK = 1 << 18
_NODES = 1024


def gram_counts(labelled: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n): how often each run of ``ORDER + 1`` bytes (packed, first byte highest)
    occurs in the whole texts of each language; a text's start counts as preceded by spaces."""
    schema = "lang string, gram long, n long"

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 4 * ROWS_AT_ONCE):
                batch = whole.slice(start, 4 * ROWS_AT_ONCE)
                by_lang: dict[str, list[np.ndarray]] = {}
                for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(_grams(text.encode()))
                for lang, runs in by_lang.items():
                    grams, n = np.unique(np.concatenate(runs), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)),
                         pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    rows = labelled.select(F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")).where(
        F.col(f"`{text_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull())
    return map_arrow(rows, run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _grams(data: bytes) -> np.ndarray:
    b = np.frombuffer(b" " * ORDER + data, np.uint8).astype(np.uint32)
    n = len(data)
    out = np.zeros(n, np.uint32)
    for k in range(ORDER + 1):
        out = (out << np.uint32(8)) | b[k:k + n]
    return out


class PpmModel:
    """Frozen context trees of all languages. ``langs``: names; ``grams``: distinct packed grams;
    ``counts``: [grams, languages]."""

    def __init__(self, langs: list[str], grams: np.ndarray, counts: np.ndarray):
        self.langs = langs
        self._grams, self._counts = grams.astype(np.uint32), counts.astype(np.float64)
        self._table: np.ndarray | None = None

    def __getstate__(self):  # the look-up table is rebuilt where it is used: counts are smaller
        return {**self.__dict__, "_table": None, "_node": None, "_symbol": None}

    def _build(self) -> None:
        # Bytes never seen in training are alike to every context: one symbol, 0, stands for each.
        parts = [(self._grams >> np.uint32(8 * (ORDER - k))) & np.uint32(255) for k in range(ORDER + 1)]
        seen = np.unique(np.concatenate([*parts, np.array([32], np.uint32)]))
        symbol = np.zeros(256, np.int64)
        symbol[seen] = np.arange(1, len(seen) + 1)
        size, n_lang = len(seen) + 1, len(self.langs)
        parts = [symbol[p] for p in parts]
        others = 256 - len(seen)  # the bytes that symbol 0 stands for

        def mixed(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
            """[nodes, symbols] probabilities of a byte from counts and the shorter context's."""
            total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            mass = np.where(counts > 0, 0, lower)
            mass[:, 0] *= others
            open_mass = mass.sum(1, keepdims=True)
            escape = distinct / np.maximum(total + distinct, 1) / np.maximum(open_mass, 1e-300)
            p = np.where(counts > 0, counts / np.maximum(total + distinct, 1), lower * escape)
            full = (open_mass <= 0) & (distinct > 0)  # nothing left to escape to
            p = np.where(full, counts / np.maximum(total, 1), p)
            return np.where(total > 0, p, lower)

        # ids of contexts by order: a context's key is its symbols, oldest first, in base `size`
        keys, places = [np.zeros(1, np.int64)], [np.zeros(len(self._grams), np.int64)]
        for order in range(1, ORDER + 1):
            key = np.zeros(len(self._grams), np.int64)
            for p in parts[ORDER - order:ORDER]:
                key = key * size + p
            distinct, at = np.unique(key, return_inverse=True)
            keys.append(distinct)
            places.append(at)
        table = np.empty((sum(map(len, keys)) * size, n_lang), np.float32)
        for lang in range(n_lang):
            lower, first = np.full((1, size), 1 / 256), 0
            for order in range(ORDER + 1):
                n_nodes = len(keys[order])
                shorter = np.searchsorted(keys[order - 1], keys[order] % size ** (order - 1)) if order else np.zeros(1, np.int64)
                by_node = np.argsort(places[order], kind="stable")
                ends = np.searchsorted(places[order][by_node], np.arange(n_nodes + 1))
                kept = []
                for a in range(0, n_nodes, _NODES):  # some nodes at a time: the working arrays are large
                    b = min(a + _NODES, n_nodes)
                    grams = by_node[ends[a]:ends[b]]
                    counts = np.zeros((b - a, size))
                    np.add.at(counts, (places[order][grams] - a, parts[ORDER][grams]), self._counts[grams, lang])
                    p = mixed(counts, lower[shorter[a:b]])
                    table[(first + a) * size:(first + b) * size, lang] = -np.log2(np.maximum(p, 1e-300)).ravel()
                    if order < ORDER:
                        kept.append(p)
                first += n_nodes
                lower = np.concatenate(kept) if kept else lower
        # deepest known context of any ORDER symbols
        node = np.zeros(1, np.int64)
        first = 0
        for order in range(1, ORDER + 1):
            node = np.tile(node, size)  # a longer context falls back to its newest symbols
            first += len(keys[order - 1])
            node[keys[order]] = first + np.arange(len(keys[order]))
        self._size, self._symbol = size, symbol.astype(np.int32)
        self._node = (node * size).astype(np.int32)
        self._table = table

    def code_lengths(self, text: str) -> np.ndarray:
        """Bits of the whole text's UTF-8 under each language."""
        if self._table is None:
            self._build()
        data = text.encode()
        out = np.zeros(len(self.langs))
        for start in range(0, len(data), _CHUNK):
            before = data[max(0, start - ORDER):start]
            piece = b" " * (ORDER - len(before)) + before + data[start:start + _CHUNK]
            s = self._symbol[np.frombuffer(piece, np.uint8)]
            n = len(piece) - ORDER
            ctx = s[:n]
            for k in range(1, ORDER):
                ctx = ctx * self._size + s[k:k + n]
            out += self._table[self._node[ctx] + s[ORDER:]].sum(0, dtype=np.float64)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score; ``und`` and 0 for texts without a letter, or when none was learnt."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        bits = self.code_lengths(text)
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())

    def figures(self, text: str | None) -> tuple[str, float | None, float | None]:
        """Language, code length a byte (less :data:`SLACK_BITS`, not below 0) and distance to the second
        language a byte (plus :data:`MARGIN_SLACK_BITS`). Without a language both are None; with one learnt language the distance is."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNDETERMINED, None, None
        bits, n = self.code_lengths(text), len(text.encode())
        best = int(bits.argmin())
        second = np.delete(bits, best).min() if len(bits) > 1 else None
        return (self.langs[best], max(0.0, float(bits[best]) - SLACK_BITS) / n,
                None if second is None else (float(second - bits[best]) + MARGIN_SLACK_BITS) / n)


def _labelled(labelled: DataFrame, text_col: str, lang_col: str, id_col: str,
              max_docs: int | None) -> tuple[DataFrame, list[str]]:
    """The rows that have text, language and id, and their languages. With ``max_docs`` about so many rows a language
    (all of languages with fewer), chosen by a hash of the id."""
    rows = labelled.where(F.col(f"`{text_col}`").isNotNull() & F.col(f"`{lang_col}`").isNotNull()
                          & F.col(f"`{id_col}`").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(f"`{lang_col}`").count().collect()}
    if max_docs is None:
        return rows, sorted(sizes)
    chance = F.lit(0.0)
    for lang in sorted(sizes):
        chance = F.when(F.col(f"`{lang_col}`") == lang, F.lit(min(1.0, max_docs / sizes[lang]))).otherwise(chance)
    draw = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit(1)), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(draw < chance), sorted(sizes)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          max_docs: int | None = None) -> PpmModel:
    """Learn from the whole texts of all labelled rows (with ``max_docs`` of about so many a language, for a quick
    look). Rows without text, language or id are not learnt from. The n-gram counts are summed by Spark; their
    table (distinct runs of four bytes, which grow far slower than the texts) is collected."""
    rows, langs = _labelled(labelled, text_col, lang_col, id_col, max_docs)
    if not langs:
        return PpmModel([], np.zeros(0), np.zeros((0, 0)))
    pdf = gram_counts(rows, text_col, lang_col).toPandas()
    grams, at = np.unique(pdf["gram"].to_numpy(np.int64), return_inverse=True)
    counts = np.zeros((len(grams), len(langs)))
    counts[at, pdf["lang"].map({n: i for i, n in enumerate(langs)}).to_numpy(np.int64)] = pdf["n"].to_numpy()
    return PpmModel(langs, grams, counts)


_LOADED: dict[str, PpmModel] = {}


def identify(df: DataFrame, model: PpmModel, text_col: str = "text", lang_out: str = "lang_pred",
             score_out: str = "score", drop_text: bool = False) -> DataFrame:
    """``df`` with the predicted language of every whole text and its score (0 to 1). NULL, empty
    and letterless texts give ``und`` and 0. Columns of those names are replaced; only the text is
    read. The model (gram counts, a few MB) is broadcast; each worker builds its table once."""
    return _with_model(df, model, text_col, PpmModel.predict, (lang_out, T.StringType()), (score_out, T.DoubleType()),
                       drop_source=drop_text)


def _with_model(df: DataFrame, model: PpmModel, text_col: str, fn, *targets, drop_source: bool = False) -> DataFrame:
    """``df`` with ``fn(model, text)`` of every text as columns ``targets``; each worker builds the table once."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def run(texts: pa.Array) -> list[pa.Array]:
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = shared.value
        got = [fn(_LOADED[key], t) for t in texts.to_pylist()]
        return [pa.array([g[k] for g in got], pa.string() if type(t) is T.StringType else pa.float64())
                for k, (_, t) in enumerate(targets)]

    return map_column(df, text_col, run, *targets, drop_source=drop_source)


def measure(df: DataFrame, model: PpmModel, text_col: str = "text", lang_out: str = "lang_pred",
            bits_out: str = "bits", margin_out: str = "margin", drop_text: bool = False) -> DataFrame:
    """``df`` with :meth:`PpmModel.figures` of every whole text. Columns of those names are replaced."""
    return _with_model(df, model, text_col, PpmModel.figures, (lang_out, T.StringType()), (bits_out, T.DoubleType()),
                       (margin_out, T.DoubleType()), drop_source=drop_text)


def fit_limits(labelled: DataFrame, model: PpmModel, text_col: str = "text", lang_col: str = "lang",
               id_col: str = "doc_id", max_docs: int | None = None) -> dict[str, tuple[float, float]]:
    """{language: (longest code a byte, shortest distance a byte)} from all labelled texts (with ``max_docs`` about
    so many a language); the model must not have learnt from them. The percentiles are exact. Texts of which the model finds another language do not count. A
    learnt language without such texts takes the widest limits of the others; without any, everything is within them."""
    rows, _ = _labelled(labelled, text_col, lang_col, id_col, max_docs)
    rows = rows.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    at = written(measure(rows, model, drop_text=True).where("lang_pred = lang").select("lang", "bits", "margin"), "figures")
    margins = {r["lang"]: (r["q0"], r["q1"]) for r in grouped_quantiles(at, ["lang"], "margin", [0.5, 0.01]).collect()}
    limits = {}
    for r in grouped_quantiles(at, ["lang"], "bits", [0.5, 0.99]).collect():  # one row a language
        middle, far = r["q0"], r["q1"]
        near, low = margins.get(r["lang"], (0.0, 0.0))
        limits[r["lang"]] = (middle + SPREADS * max(far - middle, MIN_SPREAD * middle),
                             near - SPREADS * max(near - low, MIN_SPREAD * near))
    widest = (max((v[0] for v in limits.values()), default=np.inf), min((v[1] for v in limits.values()), default=-np.inf))
    return {lang: limits.get(lang, widest) for lang in model.langs}


def in_language(df: DataFrame, model: PpmModel, limits: dict[str, tuple[float, float]], text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text is in a learnt language by ``limits`` (:func:`fit_limits`), columns unchanged.
    NULL, empty and letterless texts go, and so do those in no learnt language or in two of them. Texts of a few
    bytes stay unless they are far off (:data:`SLACK_BITS`); every row of a repeated text is judged alike."""
    taken = {c.lower() for c in df.columns}
    out = "__fits"
    while out in taken:
        out += "_"

    def fits(model: PpmModel, text: str | None) -> tuple[float]:
        lang, bits, margin = model.figures(text)
        if lang == UNDETERMINED:
            return (0.0,)
        longest, shortest = limits[lang]
        return (float(bits <= longest and (margin is None or margin >= shortest)),)

    rows = _with_model(df, model, text_col, fits, (out, T.DoubleType()))
    return rows.where(F.col(out) > 0).select(*[F.col(f"`{c}`") for c in df.columns])


def held_out(id_col: Column) -> Column:
    """Rows whose language is never learnt: crc32 of the id as text, modulo 4, is 2 (or no id)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def learn_and_identify(spark: SparkSession, docs: DataFrame, drop_text: bool = False) -> DataFrame:
    """Train on the rows that are not held out, predict every row."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model, drop_text=drop_text)
