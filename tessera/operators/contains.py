"""Substring join: texts with the patterns that they contain, in time linear in the texts.

Every pattern is known by the hashes of its first and of its last 2**k bytes, k being
the most that fit, so the two cover it. Texts are read once, in stretches: rolling
hashes of all runs of 1, 2, 4, ... bytes come from each other by one step a doubling,
and a place where the first hash of a pattern stands, and its last one where the pattern
would end, is a hit. A hit counts when the SHA-256 of the text's bytes there is the
pattern's. Only hits leave the task; they meet the patterns again by that digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.names import free_names

#: Different patterns that are searched for in one pass over the texts; 57 bytes each go with the tasks.
_AT_ONCE = 1_000_000
#: Bytes of text hashed at once, and pairs of a place and a pattern looked at at once.
_STRETCH = 1 << 20
_Q = 0xD1342543DE82EF95
_VALUES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _doubled(data: np.ndarray, levels: int) -> Iterator[tuple[int, np.ndarray]]:
    """k and the hashes of all runs of 2**k bytes, for k up to ``levels``, while they fit."""
    h, power = _VALUES[data], _Q
    for k in range(levels + 1):
        if not len(h):
            return
        yield k, h
        size = 1 << k
        h = h[:-size] * np.uint64(power) + h[size:] if len(h) > size else h[:0]
        power = power * power % (1 << 64)


def _print(pattern: bytes) -> tuple[int, int]:
    """Hashes of a pattern's first and last 2**k bytes."""
    *_, (k, h) = _doubled(np.frombuffer(pattern, np.uint8), len(pattern).bit_length() - 1)
    return int(h[0]), int(h[len(pattern) - (1 << k)])


class Patterns:
    """Prints of patterns, by the level of their length."""

    def __init__(self, size: np.ndarray, first: np.ndarray, last: np.ndarray, digest: np.ndarray):
        self.digest, self.longest, self.levels = digest, int(size.max(initial=0)), {}
        self.empty = np.flatnonzero(size == 0)
        level = np.array([int(n).bit_length() - 1 for n in size], np.int64)
        for k in np.unique(level[level >= 0]).tolist():
            own = np.flatnonzero(level == k)
            own = own[np.argsort(first[own], kind="stable")]
            bits = max(len(own).bit_length() + 3, 8)
            seen = np.zeros(1 << bits, bool)
            seen[(first[own] >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.levels[k] = own, size[own], first[own], last[own], seen, np.uint64(64 - bits)

    def find(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of a text and a pattern in it; offsets: where texts start in ``data`` (one more at the end)."""
        found: set[tuple[int, int]] = {(t, p) for p in self.empty.tolist() for t in range(len(offsets) - 1)}
        step = max(_STRETCH, self.longest)
        for at in range(0, len(data), step):
            part = data[at : at + step + self.longest - 1]
            for k, h in _doubled(part, max(self.levels, default=-1)):
                if k in self.levels:
                    self._hits(k, h, data, at, min(step, len(h)), offsets, found)
        return sorted(found)

    def _hits(self, k: int, h: np.ndarray, data: np.ndarray, at: int, n: int, offsets: np.ndarray, found: set[tuple[int, int]]) -> None:
        own, size, first, last, seen, shift = self.levels[k]
        place = np.flatnonzero(seen[(h[:n] >> shift).astype(np.int64)])
        low, high = np.searchsorted(first, h[place]), np.searchsorted(first, h[place], "right")
        place, low, many = place[high > low], low[high > low], (high - low)[high > low]
        reach = np.cumsum(many)
        for begin in range(0, int(reach[-1]) if len(reach) else 0, _STRETCH):
            # Pairs number begin, begin + 1, ... of all places with the patterns that start as they do.
            pair = np.arange(begin, min(begin + _STRETCH, int(reach[-1])))
            of = np.searchsorted(reach, pair, "right")
            p, x = low[of] + pair - (reach - many)[of], place[of]
            end = x + size[p] - (1 << k)
            fits = end < len(h)
            p, x, end = p[fits], x[fits], end[fits]
            good = h[end] == last[p]
            p, x = p[good], x[good] + at
            text = np.searchsorted(offsets, x, "right") - 1
            inside = x + size[p] <= offsets[text + 1]
            p, x, text = p[inside], x[inside], text[inside]
            order = np.lexsort((x, p, text))
            for t, i, a in zip(text[order].tolist(), p[order].tolist(), x[order].tolist(), strict=True):
                if (t, int(own[i])) not in found and hashlib.sha256(data[a : a + int(size[i])]).digest() == self.digest[own[i]]:
                    found.add((t, int(own[i])))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes and where its values start; null as empty."""
    column = pc.fill_null(column, b"") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def substring_join(texts: DataFrame, patterns: DataFrame, text: Column, pattern: Column, keep: Sequence[str] | None = None) -> DataFrame:
    """All pairs whose text contains the pattern; columns are those of ``texts`` (or of these, ``keep``) and of ``patterns``.

    Nulls match nothing; an empty pattern is in every text. Texts and patterns of any length
    and kind of character are compared as they are, byte by byte. Equal patterns are
    searched for once. Beyond ``_AT_ONCE`` different patterns the texts are read once more
    for each so many.
    """
    spark = texts.sparkSession
    keep = list(texts.columns if keep is None else keep)
    digest, size = free_names("digest size", texts, patterns)
    body = pattern.cast("string").cast("binary")
    named = patterns.withColumn(digest, F.unhex(F.sha2(body, 256))).where(F.col(digest).isNotNull())

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).to_pylist()
            both = np.array([_print(v) if v else (0, 0) for v in values], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(v) for v in values], pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["digest", "size", "first", "last"])

    different = named.select(F.col(digest).alias("digest"), body.alias("body")).dropDuplicates(["digest"])
    known = different.mapInArrow(prints, "digest binary, size long, first long, last long")
    passes = max(1, -(-known.count() // _AT_ONCE))
    rows = texts.select(text.cast("string").cast("binary").alias(size), *[F.col(f"`{c}`") for c in keep]).where(F.col(size).isNotNull())
    schema = rows.drop(size).withColumn(digest, F.lit(b"")).schema

    def search(part: pa.Table) -> DataFrame:
        held = [part.column(c).to_numpy() for c in ("size", "first", "last")]
        wanted = Patterns(held[0], held[1].view(np.uint64), held[2].view(np.uint64), np.array(part.column("digest").to_pylist(), object))

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    pairs = wanted.find(*_bytes(batch.column(0)))
                    of = pa.array([t for t, _ in pairs], pa.int64())
                    yield pa.RecordBatch.from_arrays([*(c.take(of) for c in batch.columns[1:]), pa.array([wanted.digest[p] for _, p in pairs], pa.binary())], names=schema.names)

        return rows.mapInArrow(find, schema)

    found = None
    for i in range(passes):
        part = known.where(F.pmod(F.xxhash64("digest"), F.lit(passes)) == i).toArrow()
        hits = search(part)
        found = hits if found is None else found.unionByName(hits)
    return found.join(named, digest).drop(digest)
