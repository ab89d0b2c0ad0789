"""Vectorised words and word hashes over Arrow string columns (used inside Python tasks).

A chunk is a flat ``uint8`` buffer with row offsets. Words are runs of non-separator bytes; a 256-entry table
says which bytes separate. All separators used here are ASCII, so working on UTF-8 bytes gives the same words
as working on code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
SPACE = _SPACE                                            # words [^\x20\x09-\x0D]+
ALNUM = np.zeros(256, bool)                               # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
ALNUM[:0x30] = True
ALNUM[0x3A:0x61] = True
ALNUM[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LANE_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_null(col.type):
        col = col.cast(pa.large_string())
    elif pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null("" if pa.types.is_large_string(col.type) else b"")
    _, o, d = col.buffers()
    off = np.frombuffer(o, np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def chunks(col: pa.Array, limit: int = CHUNK_BYTES):
    """Cut a column into (first row, bytes, offsets) of about ``limit`` bytes; a longer text is a chunk alone."""
    data, off = flat(col)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def words(data: np.ndarray, off: np.ndarray, sep: np.ndarray):
    """(start, end, row) of every word, in order."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~sep[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    cut = off[(off > 0) & (off < len(data))]
    first[cut] = True
    last[cut - 1] = True
    start = np.flatnonzero(inside & first)
    end = np.flatnonzero(inside & last) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M2
    h = (h ^ (h >> np.uint64(27))) * _M3
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes at a time."""
    pad = np.zeros(len(data) + 8, np.uint8)
    pad[:len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=pad, strides=(1,))
    left = end - start
    h = (left.astype(np.uint64) + np.uint64(1)) * _M1
    at, where = start.copy(), None
    while len(at):
        v = lanes[at] & _LANE_MASK[np.minimum(left, 8)]
        if where is None:
            h = mix(h ^ v)
        else:
            h[where] = mix(h[where] ^ v)
        more = np.flatnonzero(left > 8)
        where = more if where is None else where[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive word hashes (windows over row ends are the caller's to drop)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(h) - n + 1, n, np.uint64) * _M1
    for k in range(n):
        out = mix(out ^ h[k:len(h) - n + 1 + k]) + _M1
    return out


def whole(h: np.ndarray) -> np.ndarray:
    """Hash of a word sequence shorter than a window, as one item."""
    out = np.array([len(h)], np.uint64) * _M1
    for x in h:
        out = mix(out ^ x) + _M1
    return out


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the ``n``-word shingles of one text; a shorter text is one shingle."""
    if not len(h):
        return np.zeros(0, np.int64)
    s = windows(h, n) if len(h) >= n else whole(h)
    return np.unique(s >> np.uint64(1)).view(np.int64)


def rows_of(row: np.ndarray, n: int) -> np.ndarray:
    """Where each row's words begin, with the end: length ``n`` + 1."""
    return np.searchsorted(row, np.arange(n + 1))
