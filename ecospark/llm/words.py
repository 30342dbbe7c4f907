"""Word, line and shingle arithmetic over whole texts, vectorised with numpy inside tasks.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` (ASCII white space), so a UTF-8 text can be cut on its
bytes. A word is named by a 64-bit hash: a polynomial over table-mixed bytes (computed for all words of a text at
once from one wrapping prefix sum) followed by a finaliser. Everything is a pure function of the bytes: the same on
every executor and after every retry.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: the polynomial's base and its inverse modulo 2^64 (any odd number has one)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (xor-shift-multiply rounds); a bijection."""
    x = np.asarray(x, dtype=_U).copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=_U))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers up to ``n``; kept for the usual lengths, made anew for very long texts."""
    if n <= _BLOCK:
        return _POW, _INV
    return _powers(_BASE, n), _powers(_INVERSE, n)


def text_bytes(text: str | None, lower: bool = True) -> np.ndarray:
    """UTF-8 bytes of a text (null: none), A-Z lower-cased if asked."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return _LOWER[raw] if lower else raw


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of ``data``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = np.empty(len(data) + 2, dtype=np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = ~_SPACE[data]
    edge = np.diff(solid)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings ``data[start:end]``."""
    if not len(start):
        return np.zeros(0, dtype=_U)
    power, inverse = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_TABLE[data] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray) -> np.ndarray:
    return span_hashes(data, *word_spans(data))


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every window of ``n`` consecutive items (none if there are fewer)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=_U)
    out = hashes[:count].copy()
    for k in range(1, n):
        out = mix(out + _U(0x2545F4914F6CDD1D)) ^ hashes[k : k + count]
    return mix(out)


def shingles(data: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's ``n``-word shingles; a text with fewer words is one shingle, one without
    words has none."""
    words = word_hashes(data)
    if not len(words):
        return words
    return np.unique(chain(words, min(n, len(words))))
