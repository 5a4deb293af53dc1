"""Exact deduplication by content-defined chunk recipes.

Each normalised text is cut where a rolling hash of its bytes says so, so equal
texts are cut alike wherever they stand. A document becomes its recipe, the
ordered list of its chunks' identifiers; recipes, about a twentieth of the text,
are all that is shuffled. A chunk's fast hash is verified by its SHA-256: contents
that share a fast hash get different ordinals, and the identifier is (hash,
ordinal). Two documents are equal if their identifier lists are equal.

Only documents whose list of fast hashes occurs more than once can be equal, so
identifiers are resolved for those alone. Groups are aggregated with partial
sums, and the join back is one that Spark can split, so a group with a third of
all rows is no task of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, texts

_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
_WINDOW = 16


def _cuts(norm: bytes, hits: np.ndarray, least: int, most: int) -> list[int]:
    """Ends of the chunks of one text; hits: where the content allows a cut."""
    out, at, n = [], 0, len(norm)
    for e in hits.tolist():
        while e - at > most:
            at += most
            out.append(at)
        if e - at >= least:
            out.append(e)
            at = e
    while n - at > most:
        at += most
        out.append(at)
    if at < n:
        out.append(n)
    return out


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = 1024, least: int = 256, most: int = 8192) -> DataFrame:
    """uid (the row's place), doc_id, n_chars, text_sha256, signature and the chunks (h, digest, length) of each row.

    mean, least, most: bytes of a chunk; mean is a power of two, least over 16.
    """
    if least <= _WINDOW or mean & (mean - 1):
        raise ValueError("least must be over 16 and mean a power of two")
    shift = np.uint32(32 - (mean.bit_length() - 1))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_chars, shas, signatures, chunks = [], [], [], []
            for _, _, data, offsets in texts.blocks(batch.column(2)):
                n_chars += texts.code_points(data, offsets).tolist()
                raw = data.tobytes()
                norms = [raw[a:b].translate(None, texts.SEPARATORS) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                h = _GEAR[np.frombuffer(b"".join(norms), np.uint8)]
                size = 1
                while size < _WINDOW:  # the hash of 2 * size bytes from two of size bytes
                    h[size:] += h[:-size].copy() << np.uint32(size)
                    size *= 2
                hits, at = np.flatnonzero((h >> shift) == 0) + 1, 0
                for norm in norms:
                    lo, hi = np.searchsorted(hits, (at + _WINDOW, at + len(norm)), "left")
                    ends = _cuts(norm, hits[lo:hi] - at, least, most)
                    at += len(norm)
                    whole, rows, start = xxhash.xxh3_64(len(norm).to_bytes(8, "little")), [], 0
                    for e in ends:
                        piece = norm[start:e]
                        fast = xxhash.xxh64_intdigest(piece)
                        whole.update(fast.to_bytes(8, "little"))
                        rows.append({"h": fast - (fast >> 63 << 64), "digest": hashlib.sha256(piece).digest(), "length": e - start})
                        start = e
                    shas.append(hashlib.sha256(norm).hexdigest())
                    s = whole.intdigest()
                    signatures.append(s - (s >> 63 << 64))
                    chunks.append(rows)
            kind = pa.list_(pa.struct([("h", pa.int64()), ("digest", pa.binary()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_chars, pa.int64()), pa.array(shas, pa.string()), pa.array(signatures, pa.int64()), pa.array(chunks, kind)], ["uid", "doc_id", "n_chars", "text_sha256", "signature", "chunks"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = scratch.identified(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "uid").select("uid", "doc_id", "text")
    return scratch.map_arrow(scratch.spread(rows), cut, f"uid struct<file: long, place: long>, doc_id {kind}, n_chars long, text_sha256 string, signature long, chunks array<struct<h: long, digest: binary, length: int>>")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **cutting: int) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chars, n_chunks, row.

    Texts are equal if identical without the characters of ``[\\x20\\x09-\\x0D]``. Of
    equal texts the row with most code points stays, then the smallest doc_id (null
    last). Null text is empty; all empty texts are equal. A text of any length is read
    whole, as a list of chunks. Of repeated rows with the same doc_id and text, which
    tie, the first by place stays. An empty table gives an empty result; other columns,
    whatever their names, are not read. ``docs`` may be any DataFrame: rows that are
    not those of one Parquet table are written first.
    """
    slim = scratch.materialize(recipes(docs, id_col, text_col, **cutting), "recipes")
    repeated = scratch.materialize(slim.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("signature").alias("s")), "repeated")
    candidates = scratch.materialize(slim.join(repeated, F.col("signature") == F.col("s"), "left_semi"), "candidates")

    # The registry of distinct chunks: contents under one fast hash are told apart by their digest.
    chunk = candidates.select("uid", F.posexplode("chunks").alias("pos", "c")).select("uid", "pos", "c.h", "c.digest")
    clashes = chunk.groupBy("h").agg(F.array_sort(F.collect_set("digest")).alias("known")).where(F.size("known") > 1)
    ordinals = clashes.select("h", F.posexplode("known").alias("ordinal", "digest"))
    named = chunk.join(ordinals, ["h", "digest"], "left").select("uid", "pos", "h", F.coalesce("ordinal", F.lit(0)).alias("ordinal"))
    lists = named.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h", "ordinal"))), lambda x: F.struct(x["h"], x["ordinal"])).alias("ids"))
    none = F.array().cast("array<struct<h: long, ordinal: int>>")
    listed = candidates.select("uid", "doc_id", "n_chars", "text_sha256", "signature", F.size("chunks").alias("n_chunks")).join(lists, "uid", "left").withColumn("ids", F.coalesce("ids", none))
    listed = scratch.materialize(listed, "lists")

    best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid")))
    groups = scratch.materialize(listed.groupBy("signature", "ids").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    found = listed.join(groups, ["signature", "ids"]).select("doc_id", F.col("best.keep_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.keep_uid")).alias("kept"), "text_sha256", "n_chars", F.col("n_chunks").cast("long").alias("n_chunks"), F.col("uid").alias("row"))
    alone = slim.join(repeated, F.col("signature") == F.col("s"), "left_anti").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "n_chars", F.size("chunks").cast("long").alias("n_chunks"), F.col("uid").alias("row"))
    return alone.unionByName(found)
