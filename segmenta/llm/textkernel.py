"""Vectorised word and shingle hashing over Arrow string arrays.

A word is a maximal run of ASCII letters and digits and of non-ASCII bytes, in
lower case (ASCII and Latin-1 letters).  Everything else separates words.  All
functions take whole texts; null and empty texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass holds; a single longer text is one pass of its own.
CHUNK_BYTES = 1 << 19

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _lut() -> np.ndarray:
    lut = np.zeros(256, np.uint8)
    for c in range(256):
        if c >= 128 or chr(c).isalnum():
            lut[c] = ord(chr(c).lower()) if c < 128 else c
    return lut


_LUT = _lut()
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_ALL = _BYTE.copy()
_BYTE[0] = 0
_SHINGLE = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for k, p in enumerate((_P, _P_INV)):
            steps = np.full(size, p, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (from 0) of a string array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offs - offs[0]


def pieces(offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes; each has one document at least."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def fold(body: np.ndarray) -> np.ndarray:
    """Lower-cased bytes, 0 where a separator stands."""
    low = _LUT[body]
    after = np.flatnonzero(body[:-1] == 0xC3) + 1
    if len(after):
        v = low[after]
        low[after] = np.where((v >= 0x80) & (v <= 0x9E) & (v != 0x97), v + 32, v)
    return low


def _spans(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, first and last byte of each word) of one piece."""
    low = fold(body)
    is_word = low != 0
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    filled = offs[:-1] < offs[1:]
    at, end = offs[:-1][filled], offs[1:][filled] - 1
    first[at] |= is_word[at]
    last[end] |= is_word[end]
    return low, np.flatnonzero(first), np.flatnonzero(last)


def _hash(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _pow(len(low))
    run = np.add.accumulate(_BYTE[low] * up)
    h = run[ends] - run[starts] + _BYTE[low[starts]] * up[starts]
    h *= down[starts]
    return mix64(h)


def words(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each document) of one piece."""
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(len(offs) - 1, np.int64)
    low, starts, ends = _spans(body, offs)
    return _hash(low, starts, ends), np.diff(np.searchsorted(starts, offs))


def words_and_beginnings(body: np.ndarray, offs: np.ndarray, sizes: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashes of each word and of its first bytes, for each of ``sizes``; number of words of each document)."""
    if not len(body):
        return [np.zeros(0, np.uint64)] * (1 + len(sizes)), np.zeros(len(offs) - 1, np.int64)
    low, starts, ends = _spans(body, offs)
    out = [_hash(low, starts, ends)] + [_hash(low, starts, np.minimum(ends, starts + n - 1)) for n in sizes]
    return out, np.diff(np.searchsorted(starts, offs))


def shingles(h: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``size`` words, their number per document).

    A document of fewer words, but at least one, has one shingle of all its words.
    """
    total = len(h)
    if size == 1 or not total:
        return h, counts
    begin = np.cumsum(counts) - counts
    left = np.repeat(begin + counts, counts) - np.arange(total)
    acc = np.zeros(total, np.uint64)
    for j in range(size):
        acc[: max(0, total - j)] += h[j:] * _SHINGLE[j]
    keep = left >= size
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        at = begin[short]
        own = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = counts[short] > j
            own[has] += h[at[has] + j] * _SHINGLE[j]
        acc[at] = own
        keep[at] = True
    return mix64(acc[keep]), np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
