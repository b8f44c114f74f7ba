"""Arrow string arrays as flat numpy code-point arrays, and back.

A batch of texts becomes one ``uint32`` array of code points and one array of row offsets; all work on
characters is then array arithmetic over the whole batch. Null and empty rows have no code points.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SPAN = 0x110000


def decode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, and n + 1 row offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    lo, hi = int(offs[0]), int(offs[-1])
    if hi == lo:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[lo:hi]
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.zeros(hi - lo + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
    return points, starts[offs - lo]


def encode(points: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The reverse of ``decode``; ``null`` marks the rows that are null."""
    n = len(offsets) - 1
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    ends = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=ends[1:])
    out = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends[offsets].tobytes()), pa.py_buffer(data))
    if null is not None and null.any():
        out = pa.compute.if_else(pa.array(~null), out, pa.scalar(None, pa.large_string()))
    return out.cast(pa.string())


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each code point."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


LETTER, DIGIT, CJK, SPACE, MARK = 1, 2, 4, 8, 16


@functools.cache
def classes() -> np.ndarray:
    """Bit set of LETTER, DIGIT, CJK, SPACE and MARK for every code point."""
    out = np.zeros(SPAN, np.uint8)
    for i in range(SPAN):
        kind = unicodedata.category(chr(i))
        if kind[0] == "L":
            out[i] = LETTER
        elif kind[0] == "N":
            out[i] = DIGIT
        elif kind[0] == "M":
            out[i] = MARK
        elif kind[0] == "Z" or i in (9, 10, 11, 12, 13, 0x1C, 0x1D, 0x1E, 0x1F, 0x85):
            out[i] = SPACE
    for lo, hi in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF), (0x2F00, 0x2FDF), (0x2E80, 0x2EFF)):
        out[lo : hi + 1] |= CJK
    return out


@functools.cache
def lower_table() -> np.ndarray:
    """Lower-case mapping of one code point to one."""
    out = np.arange(SPAN, dtype=np.uint32)
    for i in range(min(SPAN, sys.maxunicode + 1)):
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


@functools.cache
def random_table(seed: int) -> np.ndarray:
    """A fixed random 64-bit number for each code point: the letters of the rolling hashes."""
    return np.random.default_rng(seed).integers(1, 2**63, SPAN, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _powers(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power(n: int, base: int) -> np.ndarray:
    size = 1 << 16
    while size < n:
        size *= 2
    return _powers(size, base)[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of ``values[i] * BASE**i`` modulo 2**64 (values are random 64-bit numbers)."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(len(values), BASE), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of [start, end), the same wherever the same values stand."""
    return (prefix[end] - prefix[start]) * _power(len(prefix), BASE_INVERSE)[start]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of a 64-bit hash."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def slices(column: pa.Array, points: int = 1 << 20):
    """(first row, rows) of consecutive slices of at most ``points`` bytes each, or of one longer row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    size = pa.compute.binary_length(column.cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(size), 0
    while start < n:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + points, side="right")))
        yield start, column.slice(start, stop - start)
        start = stop


def words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch: hash, start, end of each, and n + 1 row offsets into them.

    A word is a run of letters and digits in lower case; each Chinese character is a word of its own; all other
    signs only part words.
    """
    kind = classes()[points]
    word = (kind & (LETTER | DIGIT)) > 0
    alone = word & ((kind & CJK) > 0)
    edge = np.zeros(len(points) + 1, bool)
    edge[offsets] = True
    if len(points):
        before = np.concatenate(([False], word[:-1]))
        solo = np.concatenate(([False], alone[:-1]))
        first = word & (~before | alone | solo | edge[:-1])
        after = np.concatenate((word[1:], [False]))
        solo = np.concatenate((alone[1:], [False]))
        last = word & (~after | alone | solo | edge[1:])
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    else:
        start = end = np.zeros(0, np.int64)
    prefix = prefix_hash(random_table(1)[lower_table()[points]])
    return mix(span_hash(prefix, start, end)), start, end, np.searchsorted(start, offsets)
