"""Vectorised words of Arrow text columns.

Works on UTF-8 bytes: every byte of a non-ASCII code point is >= 0x80, so word classes that treat all non-ASCII code
points alike can be decided byte by byte. A word gets a 64-bit polynomial hash over random byte values; callers that
must be exact verify equal hashes against the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWERED_VALUE = _BYTE_VALUE[_LOWER]


def _table(separator) -> np.ndarray:
    return np.array([not separator(b) for b in range(256)])


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z
ALNUM = _table(lambda b: b < 0x80 and not chr(b).isalnum())
#: ``[^\x20\x09-\x0D]+``
BLANK = _table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SEGMENT + 1)
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """The words of documents ``first`` to ``last`` (exclusive) of a batch; ``doc`` counts from the batch's start."""

    first: int
    last: int
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    width = np.int64 if large else np.int32
    o = np.frombuffer(offsets, width, count=len(column) + 1, offset=column.offset * np.dtype(width).itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), o


def _scan(data: np.ndarray, lo: int, hi: int, starts_of_docs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = data[lo:hi]
    n = hi - lo
    inside = is_word[part]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = starts_of_docs - lo
    at = at[(at > 0) & (at < n)]
    begin[at] = inside[at]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[at - 1] = inside[at - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    power, inverse = _power_tables(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LOWERED_VALUE[part] * power[:n], out=total[1:])
    h = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return s + lo, e + lo, h


def words(column: pa.Array, is_word: np.ndarray) -> Iterator[Words]:
    """Words in groups of whole documents; groups hold about SEGMENT bytes or one long document."""
    data, offsets = buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + SEGMENT, "right")) - 1
        last = min(max(last, first + 1), n)
        lo, hi = int(offsets[first]), int(offsets[last])
        parts = []
        while lo < hi:  # more than one turn only for a single long document; cut where a word ends
            cut = min(lo + SEGMENT, hi)
            while cut < hi and is_word[data[cut]] and is_word[data[cut - 1]]:
                more = data[cut : cut + SEGMENT]
                gap = np.flatnonzero(~is_word[more])
                cut = min(cut + (int(gap[0]) if len(gap) else len(more)), hi)
            parts.append(_scan(data, lo, cut, offsets[first:last], is_word))
            lo = cut
        s, e, h = (np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0] if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        doc = np.searchsorted(offsets[first + 1 : last + 1], s, "right") + first
        yield Words(first, last, doc, s, e, h)
        first = last


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hashes of ``size`` consecutive word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(0xA24BAED4963EE407)
        out += h[k : k + n]
    return mix(out)


_FOLD = bytes(_LOWER.astype(np.uint8))


def lowered(raw: bytes) -> bytes:
    """A-Z to a-z, all else unchanged."""
    return raw.translate(_FOLD)
