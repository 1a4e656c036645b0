"""Vectorised text helpers that the operators use inside tasks.

Everything works on one slice of rows at a time: ``slices`` bounds the text held, so memory does not
follow the size of a partition. Hashes are 64 bits and only ever nominate; what they nominate is
compared byte by byte where the result depends on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
NO_ID = 2**63 - 1  # a null identifier counts as the largest one

# the white space of the contracts: space and U+0009 to U+000D
SPACES = " \t\n\x0b\x0c\r"
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES.encode())] = True
# words of ASCII letters and digits and of everything beyond ASCII
IS_BREAK = np.zeros(256, bool)
IS_BREAK[:0x30] = IS_BREAK[0x3A:0x61] = IS_BREAK[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# second bytes, after 0xC3, of the capitals of the Latin-1 block
ABOVE = np.zeros(256, bool)
ABOVE[0x80:0x9F] = True
ABOVE[0x97] = False

_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_PAD = 72
_LONG = 64


def doc_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Identity of a row: its identifier and a hash of its text, so that repeated rows stay one document
    and different texts under one identifier stay two."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, in place."""
    h ^= h >> np.uint64(32)
    h *= _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    h ^= h >> np.uint64(32)
    return h


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n, at = len(column), column.offset
    buffers = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[at : at + n + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``limit`` bytes of text each; one longer row stands alone."""
    lengths = np.diff(raw(batch.column(text))[1])
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the first word of each row (one entry more than rows)."""
    inside = ~breaks[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][np.diff(offsets) > 0]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def padded(data: np.ndarray) -> np.ndarray:
    """A copy with room behind it, so that eight bytes can be read from any place."""
    out = np.zeros(len(data) + _PAD, np.uint8)
    out[: len(data)] = data
    return out


def eights(room: np.ndarray) -> np.ndarray:
    """Every eight consecutive bytes of a padded array as one number."""
    return np.ndarray((len(room) - 7,), np.dtype("<u8"), buffer=room, strides=(1,))


def hash_spans(room: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range of a padded array."""
    view, size = eights(room), ends - starts
    h = mix(size.astype(np.uint64) * _M3 + _M2)
    todo = np.flatnonzero(size <= _LONG)
    at = 0
    while len(todo := todo[size[todo] > at] if at else todo[size[todo] > 0]):
        part = view[starts[todo] + at] & _MASK[np.minimum(size[todo] - at, 8)]
        h[todo] = mix((h[todo] + _M3) ^ part * _M1)
        at += 8
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(room[starts[i] : ends[i]])
    return h


def equal_spans(room: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the byte ranges from a and from b agree over ``size`` bytes."""
    view, same = eights(room), np.ones(len(a), bool)
    todo, at = np.arange(len(a)), 0
    while len(todo := todo[size[todo] > at]):
        keep = (view[a[todo] + at] ^ view[b[todo] + at]) & _MASK[np.minimum(size[todo] - at, 8)] == 0
        same[todo[~keep]] = False
        todo = todo[keep]
        at += 8
    return same


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive elements (k - 1 fewer than elements; none if there are too few)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, out, done = hashes, 1, None, 0
    while True:
        if k & size:
            piece = power[done : done + n]
            out = piece.copy() if out is None else mix((out * _M3 + np.uint64(size)) ^ piece * _M1)
            done += size
        if size * 2 > k:
            return out if k > 1 else mix(out + _M3)
        power = mix((power[:-size] * _M3 + np.uint64(size)) ^ power[size:] * _M2)
        size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size : width - size + n])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges (start, start + count), one range after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    step = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts)
    return step + np.arange(total)


def gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte ranges one after the other, and their offsets."""
    size = ends - starts
    return data[ranges(starts, size)], np.concatenate(([0], np.cumsum(size)))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
