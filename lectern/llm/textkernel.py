"""Vectorised word kernels over Arrow string columns (numpy, inside Spark tasks).

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z are lower-cased.
Texts are treated as the one flat byte buffer that Arrow holds, cut into blocks
at white space, so memory is bounded by a block and not by the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 18
_WS = np.zeros(256, dtype=bool)
_WS[[32, 9, 10, 11, 12, 13]] = True
_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_table() -> np.ndarray:
    t = splitmix(np.arange(1, 257, dtype=np.uint64))
    t[65:91] = t[97:123]
    return t


_T = _byte_table()
_P = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each text the range of its words (n+1 bounds)."""
    hashes, starts = [], []
    at, size = 0, len(data)
    while at < size:
        end = min(at + BLOCK, size)
        if end < size:
            back = np.flatnonzero(_WS[data[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:  # a word longer than a block: on to its end, or to the end of its text
                stop = int(offsets[np.searchsorted(offsets, end, "left")])
                while end < stop and not _WS[data[end]]:
                    end += 1
        part = data[at:end]
        solid = ~_WS[part]
        cuts = offsets[(offsets > at) & (offsets < end)] - at
        first, last = np.empty(len(part), bool), np.empty(len(part), bool)
        first[0], last[-1] = True, True
        first[1:], last[:-1] = ~solid[:-1], ~solid[1:]
        first[cuts], last[cuts - 1] = True, True
        s, e = np.flatnonzero(solid & first), np.flatnonzero(solid & last) + 1
        up, down = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_T[part] * up[: len(part)], out=total[1:])
        hashes.append(splitmix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        at = end
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return words, np.searchsorted(begin, offsets)


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles (int64).

    With fewer words than ``width`` the whole sequence is the one shingle; without words the set is empty.
    """
    words, bounds = word_hashes(*flat(column))
    odd = splitmix(np.arange(101, 101 + width, dtype=np.uint64)) | _U(1)
    n = len(words) - width + 1
    rolled = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(width):
        if n > 0:
            rolled += words[j : j + n] * odd[j]
    rolled = splitmix(rolled)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1].view(np.int64)))
        elif b > a:
            whole = splitmix(np.sum(words[a:b] * odd[: b - a], keepdims=True, dtype=np.uint64) + _U(b - a))
            sets.append(whole.view(np.int64))
        else:
            sets.append(np.zeros(0, np.int64))
    return sets


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b))
