"""BPE encoding and decoding with a tokenization automaton.

The automaton reads token ids and accepts exactly the sequences that the merges produce. It
starts as one state that loops on the byte tokens; each merge ``u v -> w``, in order, is a gadget:
the state that ``u`` leads to is copied without its ``v`` arc, every ``u`` arc is redirected to the
copy, and every state with a ``u`` arc gets a ``w`` arc to where ``v`` led. All arcs of one token
lead to one state, so a state is named by the token that was read last and is fully described by
the arcs its lineage lost and when:

* the state after ``t`` lost the arcs that later merges of ``t`` took, and those its right part's state
  had lost when ``t`` was made;
* a ``w`` arc exists where the arc on its left part still existed when ``w`` was made.

Compilation builds the state table once (linear in the merges); arcs are table lookups, memoised.
A pre-split word's bytes give a lattice of token arcs; composed with the automaton it has exactly
one accepted path, found by following arcs, longest first.
Decoding emits the byte label of every arc.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheetwise.llm.bpe_tables import BpeTables, bpe_tables, split_words
from sheetwise.llm.common import map_column

#: Bounds of the per-worker memo tables (entries); a full table is emptied, results do not change.
MAX_WORDS = 250_000
MAX_ARCS = 400_000


class TokenAutomaton:
    """The compiled automaton of one vocabulary file."""

    def __init__(self, tables: BpeTables):
        self.tables = tables
        self.labels = tables.labels
        takes: dict[int, dict[int, int]] = {}
        for (left, right), order in tables.rank.items():
            takes.setdefault(left, {})[right] = order
        self._takes = takes
        self._arcs: dict[int, bool] = {}
        self._size = {t: len(b) for t, b in tables.labels.items()}

    def lost(self, token: int) -> Iterator[tuple[dict[int, int], float]]:
        """The arcs that the state after ``token`` lost, as shared tables (symbol -> order of the merge
        that took it), each with the order up to which it counts. The state was copied from that of the
        token's right part when the token was made, so what that one lost later does not count."""
        until = float("inf")
        while True:
            table = self._takes.get(token)
            if table:
                yield table, until
            if token not in self.tables.parts:
                return
            until, token = self.tables.birth[token], self.tables.parts[token][1]

    def spine(self, token: int) -> list[tuple[int, float]]:
        """The token and its left parts down to a byte, each with the order at which its arc was
        turned into the next longer one's."""
        got, until = [], float("inf")
        while True:
            got.append((token, until))
            if token not in self.tables.parts:
                return got
            until, token = self.tables.birth[token], self.tables.parts[token][0]

    def arc(self, state: int, token: int) -> bool:
        """Whether the state after token ``state`` has an arc on ``token``: no symbol on the way to it was
        lost before it was turned into the next longer one."""
        key = state << 20 | token
        got = self._arcs.get(key)
        if got is None:
            if len(self._arcs) >= MAX_ARCS:
                self._arcs.clear()
            spine = self.spine(token)
            got = self._arcs[key] = not any(
                (order := table.get(symbol)) is not None and order < until and order <= turned
                for table, until in self.lost(state) for symbol, turned in spine)
        return got

    def path(self, word: bytes) -> list[int]:
        """The only accepted token path over ``word``: a depth-first walk, longest arc first. Of
        all paths to one place in the word only one is accepted, so a place once left without
        success stays closed."""
        step, token_at, size = self.tables.step, self.tables.token_at, self._size
        arcs, arc = self._arcs, self.arc
        n = len(word)
        out: list[int] = []
        places: list[tuple[int, list[int]]] = []
        closed: set[int] = set()
        at, fits, last = 0, None, -1
        while at < n:
            if fits is None:  # the tokens that start here, shortest first
                fits, node, i = [], 0, at
                while i < n:
                    node = step.get(node << 8 | word[i])
                    if node is None:
                        break
                    i += 1
                    if node in token_at:
                        fits.append(token_at[node])
            while fits:
                token = fits.pop()
                end = at + size[token]
                if end in closed:
                    continue
                if last >= 0:
                    ok = arcs.get(last << 20 | token)
                    if ok is None:
                        ok = arc(last, token)
                    if not ok:
                        continue
                out.append(token)
                places.append((at, fits))
                at, fits, last = end, None, token
                break
            else:
                closed.add(at)
                out.pop()
                at, fits = places.pop()
                last = out[-1] if out else -1
        return out


class _Words(dict):
    """word -> path (packed 32-bit ids), filled on a miss. When full, the table becomes the older generation and an
    empty one takes its place: words still in use move over, the rest go with the next change."""

    def __init__(self, automaton: TokenAutomaton):
        super().__init__()
        self._path, self._older = automaton.path, {}

    def __missing__(self, word: str) -> bytes:
        got = self._older.get(word) or array("i", self._path(word.encode())).tobytes()
        if len(word) <= 64:
            if len(self) >= MAX_WORDS:
                self._older = dict(self)
                self.clear()
            self[word] = got
        return got


class Encoder:
    def __init__(self, path: str):
        self.tables = bpe_tables(path)
        self.automaton = TokenAutomaton(self.tables)
        self._words = _Words(self.automaton)

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids (32-bit) of a whole text."""
        parts = []
        for i, part in enumerate(self.tables.segments(text or "")):
            if i % 2:
                parts.append(array("i", [self.tables.special[part]]).tobytes())
            else:
                parts.extend(map(self._words.__getitem__, split_words(part)))
        return np.frombuffer(b"".join(parts), np.int32)


    def forget(self) -> None:
        """Empty the memo tables (a worker goes on to other tasks)."""
        self._words.clear()
        self._words._older = {}
        self.automaton._arcs.clear()


class Decoder:
    def __init__(self, path: str):
        labels = bpe_tables(path).labels
        by_id = [labels.get(i, b"") for i in range(max(labels) + 1)]
        self._size = np.array([len(b) for b in by_id], np.int64)
        self._start = np.cumsum(self._size) - self._size
        self._bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the ids one after another, as text."""
        size = self._size[ids]
        total = int(size.sum())
        first = np.cumsum(size) - size
        at = np.repeat(self._start[ids] - first, size) + np.arange(total)
        return self._bytes[at].tobytes().decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}
_DECODERS: dict[str, Decoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def decoder(path: str) -> Decoder:
    if path not in _DECODERS:
        _DECODERS[path] = Decoder(path)
    return _DECODERS[path]


def _encoded(column: pa.Array, path: str) -> pa.ListArray:
    ids = [encoder(path).encode(t) for t in column.to_pylist()]
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))


def _decoded(column: pa.ListArray, path: str) -> pa.Array:
    none = np.zeros(0, np.int32)
    return pa.array([decoder(path).decode(row.values.to_numpy() if row.is_valid else none) for row in column], pa.string())


_IDS = T.ArrayType(T.IntegerType())


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids",
           drop_text: bool = False) -> DataFrame:
    """``df`` with ``ids_col``: the token ids of the whole text (NULL counts as empty), special
    strings inside texts as their special ids, nothing added, cut or padded. A column of that name
    is replaced, and ``drop_text`` leaves the text out; all rows and other columns stay."""
    return map_column(df, text_col, lambda c: [_encoded(c, path)], (ids_col, _IDS), drop_source=drop_text,
                      after=lambda: encoder(path).forget())


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with ``text_col``: the text of the ids, special tokens included, bytes that are not
    UTF-8 replaced; NULL ids give the empty text, an id outside the vocabulary an error."""
    return map_column(df, ids_col, lambda c: [_decoded(c, path)], (text_col, T.StringType()))


def encode_and_decode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids",
                      decoded_col: str = "decoded", drop_text: bool = False) -> DataFrame:
    """:func:`encode` and :func:`decode` of what it gave, in one pass over the rows."""
    def run(column: pa.Array) -> list[pa.Array]:
        ids = _encoded(column, path)
        return [ids, _decoded(ids, path)]

    return map_column(df, text_col, run, (ids_col, _IDS), (decoded_col, T.StringType()), drop_source=drop_text,
                      after=lambda: encoder(path).forget())
