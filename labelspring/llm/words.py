"""Vectorised words and word hashes of whole Arrow string columns.

One pass of NumPy over the bytes of a slice of documents finds the words and a
64-bit content hash of each; no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10  # bytes of text that are hashed at once; a longer document is a slice of its own

_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def _byte_codes() -> np.ndarray:
    """One odd 64-bit code for each byte value."""
    return mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = np.ones(1, dtype=_U)
_inverse = np.ones(1, dtype=_U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        inv = pow(_BASE, -1, 1 << 64)
        _powers = np.full(size, _BASE, dtype=_U)
        _inverse = np.full(size, inv, dtype=_U)
        _powers[0] = _inverse[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
        np.multiply.accumulate(_inverse, out=_inverse)
    return _powers, _inverse


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


WHITE_SPACE = separators((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))  # after lower-casing

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive slices of a string column without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    wide = texts.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(wide):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1
        end = min(max(end, row + 1), len(wide))
        yield row, end, flat[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and for each document the place of its first word (one more at the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    inside = ~apart[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    powers, inverse = _tables(n)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(_CODES[low] * inverse[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * powers[ends] + (ends - starts).astype(_U))
    return hashes, np.searchsorted(starts, offsets, "left")


_CODES = _byte_codes()


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of ``size`` consecutive words, sorted; a shorter document is one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    out = np.full(n - size + 1, size, dtype=_U)
    for i in range(size):
        out = mix(out * _U(0x9FB21C651E98DF25) + hashes[i : n - size + 1 + i])
    return np.unique(out)
