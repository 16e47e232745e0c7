"""Byte-level BPE files read into plain tables: pieces, merges, special strings, word splitting."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import regex
from tokenizers import Tokenizer, pre_tokenizers

#: Fixed value: the split pattern of the byte-level vocabulary.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The standard `re` splits faster. It agrees with the pattern on characters whose classes it shares;
# `_odd_characters` finds, among the blocks below, those it does not. Texts with any other
# character are split by the tokenizer library itself (its Unicode version decides).
_BLOCKS = (range(0x0, 0x530), range(0x2010, 0x2028), range(0x2030, 0x205F), range(0x20AC, 0x20AD))
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
_LIBRARY_SPLIT = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def _odd_characters() -> str:
    """Characters of the blocks that `re` classes otherwise than letter, number, space, rest, or
    that the Unicode versions in use may class differently (unassigned ones)."""
    exact, out = regex.compile(WORD_PATTERN).findall, []
    for block in _BLOCKS:
        for c in map(chr, block):
            probe = f"a{c}{c}1 {c}!"
            split = [probe[x:y] for _, (x, y) in _LIBRARY_SPLIT.pre_tokenize_str(probe)]
            if not exact(probe) == split == _FAST(probe):
                out.append(c)
    return "".join(out)


@lru_cache(maxsize=1)
def _needs_library():
    """Search for a character outside the blocks, or an odd one inside."""
    blocks = "".join(f"{re.escape(chr(b[0]))}-{re.escape(chr(b[-1]))}" for b in _BLOCKS)
    odd = "".join(map(re.escape, _odd_characters()))
    return re.compile(f"[^{blocks}]" + (f"|[{odd}]" if odd else "")).search


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: visible Latin-1
    bytes stand for themselves, the others for the code points from 256 on, in byte order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in visible:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


def split_words(text: str) -> list[str]:
    """The words the vocabulary's pre-tokenizer makes of ``text``, in order."""
    if _needs_library()(text) is None:
        return _FAST(text)
    return [text[a:b] for _, (a, b) in _LIBRARY_SPLIT.pre_tokenize_str(text)]


class BpeTables:
    """``ids``: bytes -> id; ``labels``: id -> bytes; ``rank[(a, b)]`` -> merge order, with
    ``parts[id] = (a, b)`` and ``birth[id]`` for ids that a merge makes; ``special``: string -> id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") \
                or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        symbols = {piece: bytes(byte_of[c] for c in piece) for piece in model["vocab"]}
        self.ids = {symbols[p]: i for p, i in model["vocab"].items()}
        self.labels = {i: b for b, i in self.ids.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.birth: dict[int, int] = {}
        vocab = model["vocab"]
        for order, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = (vocab[left], vocab[right])
            made = vocab[left + right]
            self.rank.setdefault(pair, order)
            self.parts.setdefault(made, pair)
            self.birth.setdefault(made, order)
        self.special = {}
        for t in spec.get("added_tokens") or []:
            if t.get("lstrip") or t.get("rstrip") or t.get("single_word"):
                raise ValueError(f"special token with strip or single-word rules: {t['content']}")
            self.special[t["content"]] = t["id"]
            self.labels[t["id"]] = t["content"].encode()
        # byte transitions of the pieces' labels: node << 8 | byte -> node, and the token a node ends
        self.step: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        for label, token in self.ids.items():
            node = 0
            for byte in label:
                node = self.step.setdefault(node << 8 | byte, len(self.step) + 1)
            self.token_at[node] = token
        strings = sorted(self.special, key=len, reverse=True)
        self._cut = re.compile("(" + "|".join(map(re.escape, strings)) + ")") if strings else None

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` as they are when their bytes meet: no piece that
        ends ``a`` merges with one that starts ``b`` before both have grown into longer ones (of
        equal merges the left one goes first)."""
        left_until, left = float("inf"), a
        while True:
            right_until, right = float("inf"), b
            while True:
                order = self.rank.get((left, right))
                if order is not None and order < left_until and order <= right_until:
                    return False
                if right not in self.parts:
                    break
                right_until, right = self.birth[right], self.parts[right][0]
            if left not in self.parts:
                return True
            left_until, left = self.birth[left], self.parts[left][1]

    def segments(self, text: str) -> list[str]:
        """``text`` cut at special strings: ordinary text at even places, special ones at odd."""
        return self._cut.split(text) if self._cut else [text]


@lru_cache(maxsize=2)
def bpe_tables(path: str) -> BpeTables:
    return BpeTables(path)


@lru_cache(maxsize=2)
def library_tokenizer(path: str) -> Tokenizer:
    """The reference library's tokenizer of the same file (tests compare against it)."""
    return Tokenizer.from_file(path)
