"""Token counts at every prefix of a text, by dynamic programming.

Inside a pre-split word, the BPE encoding of every prefix is the encoding of a shorter prefix plus
one last token, and exactly one last token fits: the one that the merges leave apart from the
shorter prefix's own last token. ``count[i] = count[i - len(last[i])] + 1`` so holds the exact token
count of every prefix after one pass, and truncation or budget questions are look-ups. Counts of
whole words add up over a text; only a prefix that ends where the splitting depends on what
follows (white space, contractions, special strings) is counted again from the word before.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheetwise.llm.bpe_tables import BpeTables, bpe_tables, split_words
from sheetwise.llm.common import map_column

#: Bounds of the per-worker memo tables (entries); results do not depend on them.
MAX_WORDS = 500_000
MAX_PAIRS = 500_000
_CONTRACTIONS = {"'s", "'t", "'re", "'ve", "'m", "'ll", "'d"}


class _WordCounts(dict):
    """word -> bytes or tuple of its prefixes' counts (by code points), in two generations."""

    def __init__(self, tables: BpeTables):
        super().__init__()
        self._tables, self._older, self._apart = tables, {}, {}

    def __missing__(self, word: str):
        got = self._older.get(word)
        if got is None:
            got = self._count(word)
        if len(word) <= 64:
            if len(self) >= MAX_WORDS:
                self._older = dict(self)
                self.clear()
            self[word] = got
        return got

    def _count(self, word: str):
        data, t, apart = word.encode(), self._tables, self._apart
        step, token_at = t.step, t.token_at
        n = len(data)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for begin in range(n):  # every token that can follow the encoding of the first `begin` bytes
            before, node, end = last[begin] << 20, 0, begin
            while end < n:
                node = step.get(node << 8 | data[end])
                if node is None:
                    break
                end += 1
                token = token_at.get(node)
                if token is None or last[end] >= 0:
                    continue
                if begin:
                    ok = apart.get(before | token)
                    if ok is None:
                        if len(apart) >= MAX_PAIRS:
                            apart.clear()
                        ok = apart[before | token] = t.stay_apart(last[begin], token)
                    if not ok:
                        continue
                last[end] = token
                count[end] = count[begin] + 1
        if len(data) != len(word):  # code points end before a byte that starts the next one
            count = [c for i, c in enumerate(count) if i == n or i == 0 or data[i] & 0xC0 != 0x80]
        return bytes(count[1:]) if count[-1] < 256 else tuple(count[1:])


class PrefixCounter:
    """Exact token counts of a text's prefixes under one vocabulary file."""

    def __init__(self, path: str):
        self.tables = bpe_tables(path)
        self._words = _WordCounts(self.tables)

    def total(self, text: str | None) -> int:
        """Tokens of the whole text: the last prefix of every word, summed."""
        n, words = 0, self._words
        for i, part in enumerate(self.tables.segments(text or "")):
            n += 1 if i % 2 else sum([words[w][-1] for w in split_words(part)])
        return n

    def prefixes(self, text: str | None) -> list[int]:
        """Tokens of ``text[:i]`` for every i from 0 to the length."""
        out, words = [0], self._words
        base = 0
        parts = self.tables.segments(text or "")
        for i, part in enumerate(parts):
            if i % 2:
                # an unfinished special string is ordinary text and may join the word before it
                before = split_words(parts[i - 1])[-2:]
                start = base - sum(words[w][-1] for w in before)
                for k in range(1, len(part)):
                    out.append(start + self._ordinary("".join(before) + part[:k]))
                base += 1
                out.append(base)
                continue
            before = ""
            for word in split_words(part):
                counts = words[word]
                if word in _CONTRACTIONS:
                    out.extend(base + self._ordinary(word[:k]) for k in range(1, len(word)))
                    out.append(base + counts[-1])
                elif word[0].isspace() and before.isspace():
                    n = len(word) if word.isspace() else 1
                    start = base - words[before][-1]
                    out.extend(start + self._ordinary(before + word[:k]) for k in range(1, n + 1))
                    out.extend(base + c for c in counts[n:])
                else:
                    out.extend(base + c for c in counts)
                before, base = word, base + counts[-1]
        return out

    def _ordinary(self, text: str) -> int:
        return sum(self._words[w][-1] for w in split_words(text))

    def fitting(self, text: str | None, budget: int) -> int:
        """Code points of the longest prefix whose every shorter prefix, and itself, has at most
        ``budget`` tokens (prefix counts can fall again by a few where a word is completed)."""
        highest, most = 0, []
        for c in self.prefixes(text):
            highest = max(highest, c)
            most.append(highest)
        return bisect_right(most, budget) - 1


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter a worker process and vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_tokens(df: DataFrame, path: str, text_col: str = "text", out_col: str = "n_tokens",
                 drop_text: bool = False) -> DataFrame:
    """``df`` with the token count of every whole text (NULL and empty: 0), special strings inside
    texts as one token, nothing added, cut or padded. A column named ``out_col`` is replaced; all
    rows stay, repeated ones too."""
    return map_column(df, text_col, lambda texts: [pa.array(map(counter(path).total, texts.to_pylist()), pa.int64())],
                      (out_col, T.LongType()), drop_source=drop_text)


def prefix_counts(df: DataFrame, path: str, text_col: str = "text", out_col: str = "prefix_tokens") -> DataFrame:
    """``df`` with the token counts of all prefixes, by code points from 0 to the whole text."""
    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(map(counter(path).prefixes, texts.to_pylist()), pa.list_(pa.int32()))]

    return map_column(df, text_col, run, (out_col, T.ArrayType(T.IntegerType())))


def truncate(df: DataFrame, path: str, budget: int, text_col: str = "text", out_col: str = "truncated") -> DataFrame:
    """``df`` with the longest prefix of the text that stays within ``budget`` tokens throughout."""
    def cut(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([None if t is None else t[:counter(path).fitting(t, budget)]
                          for t in texts.to_pylist()], pa.string())]

    return map_column(df, text_col, cut, (out_col, T.StringType()))
