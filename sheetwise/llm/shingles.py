"""Word sequences and word-shingle sets as 64-bit hashes (NumPy, one text at a time)."""

from __future__ import annotations

import numpy as np

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
                np.uint64)
#: Bytes hashed together (words are never cut).
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self, base: int = int(_ODD[0])):
        self._bases = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self._up) < n:
            self._up, self._down = (
                np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
                for p, base in zip((self._up, self._down), self._bases, strict=True))
        return self._up[:n], self._down[:n]


POWERS = Powers()
_SPACE = np.zeros(256, bool)
_SPACE[[*b" \t\n\x0b\x0c\r"]] = True
#: A random value for every byte; capital letters A-Z have that of their small letters.
_BYTE = mix(np.arange(256, dtype=np.uint64) + _ODD[5])
_BYTE[[*range(65, 91)]] = _BYTE[[*range(97, 123)]]


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words in order: lower-cased (A-Z), parted by ``[\x20\x09-\x0D]``. A word's
    hash is a polynomial in its bytes' values, taken from prefix sums over the text."""
    data = np.frombuffer(text.encode() if text else b"", np.uint8)
    out, at = [], 0
    while at < len(data):
        end = at + _CHUNK
        while end < len(data) and not _SPACE[data[end]]:
            gap = np.flatnonzero(_SPACE[data[end:end + _CHUNK]])
            end = end + int(gap[0]) if len(gap) else end + _CHUNK
        out.append(_hashes(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hashes(data: np.ndarray) -> np.ndarray:
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = POWERS.upto(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start])


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, in order; the whole sequence as one where it is shorter."""
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    out = np.full(len(hashes) - k + 1, k, np.uint64)
    for j in range(k):
        out += hashes[j:len(hashes) - k + 1 + j] * _ODD[j % len(_ODD)] + np.uint64(j)
    return mix(out)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct shingles of a text; empty without words."""
    return np.unique(shingles(word_hashes(text), n))


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set, as signed integers."""
    a = np.add.reduce(mix(s ^ _ODD[6])) if len(s) else np.uint64(0)
    b = np.add.reduce(mix(s ^ _ODD[7])) if len(s) else np.uint64(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
