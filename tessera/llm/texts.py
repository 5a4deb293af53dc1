"""Vectorised work on whole texts inside Arrow batches.

Words are maximal runs of bytes outside space and 0x09-0x0D. Those bytes never
occur inside a multi-byte UTF-8 sequence, so words can be found on bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The word separators of all operators here.
SEPARATORS = b" \t\n\x0b\x0c\r"
WORDS_SPLIT = "[\\x20\\x09-\\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[list(SEPARATORS)] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
#: Masks of the first 0 to 8 bytes of eight.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = 128


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 18, rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of at most ``rows`` rows of about ``limit`` bytes: first row, end row, bytes, offsets from 0.

    A text longer than ``limit`` forms a run of its own. Null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + rows)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each text."""
    total = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return total[offsets[1:]] - total[offsets[:-1]]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each text's first word (one more at the end)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes.

    Bytes go in by eights, each eight through a mix of all bits before the next, so that
    no two words collide by the form of the hash; those of one length up to 8 never do.
    Words over ``_LONG`` bytes are hashed one by one.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    h = mix64((eight[starts] & _MASK[np.minimum(lens, 8)]) ^ mix64(lens.astype(np.uint64) * _M2 + _P))
    for at in range(8, min(int(lens.max()), _LONG), 8):
        more = np.flatnonzero(lens > at)
        h[more] = mix64(h[more] * _P + (eight[starts[more] + at] & _MASK[np.minimum(lens[more] - at, 8)]))
    for i in np.flatnonzero(lens > _LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return h


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` elements, each element mixed in before the next; ends that don't fit are left out."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = h[:n]
    for i in range(1, k):
        out = mix64(out * _P + h[i : i + n])
    return mix64(out + np.uint64(k))


def joined_words(raw: bytes, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], bytes, np.ndarray, np.ndarray]:
    """Each text's words joined by single spaces, all of them one after the other, and where each word starts and ends there."""
    parts = [b" ".join(raw[a:b].split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    size = ends - starts + 1
    begin = np.cumsum(size) - size
    return parts, b" ".join(filter(None, parts)), begin, begin + size - 1


def digests(joined: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b of each stretch of bytes, as two longs."""
    view = memoryview(joined)
    out = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(begin.tolist(), end.tolist(), strict=True))
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def rolling(h: np.ndarray, k: int, q: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``k`` elements, by doubling; ends that don't fit are left out."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    size, power, cur = 1, np.uint64(q), h
    out, out_size = None, 0
    left = k
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if out is None:
                    out, out_size = cur, size
                else:
                    n = len(h) - out_size - size + 1
                    out = out[:n] * power + cur[out_size : out_size + n]
                    out_size += size
            left >>= 1
            if left:
                n = len(h) - 2 * size + 1
                cur = cur[:n] * power + cur[size : size + n]
                size, power = 2 * size, power * power
    return out


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` elements."""
    if len(h) < w:
        return np.zeros(0, h.dtype)
    size, cur = 1, h
    while 2 * size <= w:
        cur = np.minimum(cur[: len(cur) - size], cur[size:])
        size *= 2
    n = len(h) - w + 1
    return np.minimum(cur[:n], cur[w - size : w - size + n])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
