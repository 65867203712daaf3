"""Hashes of the parts of many texts at a time, and the classes of letters that cut them into parts.

A part is hashed as a polynomial in its characters' hashes modulo 2^64. Running sums of the whole batch give the hash of any
part of it, so that no part is ever made a string of its own.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Characters whose running sums are made at a time.
_AT_ONCE = 1 << 17
_BASE = 0xD1342543DE82EF95


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = x + _MIX[0]
    for shift, factor in ((30, _MIX[1]), (27, _MIX[2])):
        x ^= x >> np.uint64(shift)
        x *= factor
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _categories() -> list[str]:
    return [unicodedata.category(chr(c)) for c in range(sys.maxunicode + 1)]


@functools.cache
def letter_class(*categories: str) -> str:
    """Ranges of a character class, as ``re`` takes them, of the Unicode categories that begin so."""
    inside = np.array([c.startswith(categories) for c in _categories()])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in zip(edges[::2], edges[1::2]))


@functools.cache
def _points() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point, whether it is a letter or digit, and its hash."""
    return np.array([c[0] in "LN" for c in _categories()]), mixed(np.arange(sys.maxunicode + 1, dtype=np.uint64))


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers_of_base(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _powers[i] = np.cumprod(np.append(np.uint64(1), np.full(max(n, 1 << 18), base, dtype=np.uint64)))
    return [p[:n] for p in _powers]


def part_hashes(characters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the parts from ``start`` to before ``end``, in order and apart from one another, of a row of characters.

    The running sums are made for so many characters at a time that they stay near the processor.
    """
    table, out = _points()[1], np.empty(len(start), dtype=np.uint64)
    cuts = np.append(np.searchsorted(start, np.arange(_AT_ONCE, len(characters), _AT_ONCE)), len(start))
    for i, k in zip(np.append(0, cuts), cuts):
        if i < k:
            first, last = start[i], end[k - 1]
            power, inverse = _powers_of_base(last - first + 1)
            sums = np.zeros(last - first + 1, dtype=np.uint64)
            np.cumsum(table[characters[first:last]] * power[:-1], out=sums[1:])
            begin, finish = start[i:k] - first, end[i:k] - first
            out[i:k] = mixed((sums[finish] - sums[begin]) * inverse[begin] + (finish - begin).astype(np.uint64))
    return out


def string_bytes(strings: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in one row, and where each begins and the last ends."""
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64) if len(strings) else np.zeros(1, dtype=np.int64)
    held = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return held, at - at[0]


def string_hashes(strings: pa.StringArray) -> np.ndarray:
    data, at = string_bytes(strings)
    return part_hashes(data, at[:-1], at[1:])


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Hashes of each text's words in order: the longest runs of letters and digits, in lower case."""
    if not texts:
        return []
    lower = [t.lower() for t in texts]
    points = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    edges = np.flatnonzero(np.diff(_points()[0][points].view(np.int8), prepend=np.int8(0)))
    start, end = edges[::2], edges[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in lower])
    return np.split(part_hashes(points, start, end).view(np.int64), np.searchsorted(start, text_ends)[:-1])
