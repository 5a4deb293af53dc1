"""Substring deduplication by seed and extend.

A window is ``length`` consecutive words. Its anchor is the smallest hash among
its runs of ``anchor`` words (winnowing), so equal windows have equal anchors, and
neighbouring windows mostly share one. A run is a maximal stretch of neighbouring
windows with one anchor; its block is all words they cover, the anchor extended
both ways.

1. Scan: each document yields (anchor, block) per run, about one per twenty
   words. Runs are joined on both: a run whose block also stands in an earlier
   document is repeated as a whole. Most of a copied passage is settled here.
2. Where blocks with one anchor differ (the ends of a shared passage), texts are
   read again, and the windows of those runs are joined one by one.
3. Repeated windows are merged into maximal spans, and documents that have some
   are read once more for the words that are kept.

Anchors only bring together what may be equal; what is equal is told by the words
themselves: blocks and windows are compared by 128 bits of BLAKE2b of their words,
joined by single spaces.

An anchor or window that a third of all documents hold is counted by partial
aggregates and joined back row by row; nothing is paired within a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, texts

_Q1 = 0xD1342543DE82EF95
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _windows(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows inside a text, and each one's text; first: each text's first word."""
    n = np.maximum(np.diff(first) - length + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[:-1][doc], doc


def _runs(h: np.ndarray, first: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Text, first word, number of windows and anchor of each run."""
    start, doc = _windows(first, length)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(np.uint64)
    low = texts.window_min(texts.mix64(texts.rolling(h, anchor, _Q1)), length - anchor + 1)[start]
    new = np.ones(len(start), bool)
    new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.diff(np.append(at, len(start))), low[at]


def _lists(index: np.ndarray, rows: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.searchsorted(index, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def scan(docs: DataFrame, id_col: str, text_col: str, length: int, anchor: int) -> DataFrame:
    """uid, row, doc_id, n_words, the hash of all words, and the runs of each row: anchor, block in two longs, first word, number of windows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in texts.blocks(batch.column(3)):
                starts, ends, first = texts.words(data, offsets)
                n = hi - lo
                parts, joined, word, stop = texts.joined_words(data.tobytes(), offsets, starts, ends)
                shas = [hashlib.sha256(p).hexdigest() for p in parts]
                doc, start, count, low = _runs(texts.word_hashes(data, starts, ends), first, length, anchor)
                block = texts.digests(joined, word[start], stop[start + count + length - 2])
                begin = (start - first[doc]).astype(np.int32)
                lists = [_lists(doc, n, v, t) for v, t in ((texts.signed(low), pa.int64()), (block[:, 0], pa.int64()), (block[:, 1], pa.int64()), (begin, pa.int32()), (count.astype(np.int32), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, n) for i in range(3)), pa.array(np.diff(first)), pa.array(shas), *lists], ["uid", "row", "doc_id", "n_words", "sha", "anchor", "block1", "block2", "begin", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = scratch.identified(slim, "row").select(F.monotonically_increasing_id().alias("uid"), "row", "doc_id", "text")
    return scratch.map_arrow(scratch.spread(rows), read, f"uid long, row struct<file: long, place: long>, doc_id {kind}, n_words long, sha string, anchor array<long>, block1 array<long>, block2 array<long>, begin array<int>, n array<int>")


def _hash_windows(checked: DataFrame, length: int) -> DataFrame:
    """uid, doc_id, begin and 128 bits of every window of the runs in ``check``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            check = batch.column(3)
            for lo, hi, data, offsets in texts.blocks(batch.column(2)):
                starts, ends, first = texts.words(data, offsets)
                _, joined, word, stop = texts.joined_words(data.tobytes(), offsets, starts, ends)
                part = check.slice(lo, hi - lo)
                of = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy(zero_copy_only=False))
                run = part.flatten()
                begin, n = run.field("begin").to_numpy().astype(np.int64), run.field("n").to_numpy().astype(np.int64)
                which = np.repeat(np.arange(len(n)), n)
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + begin[which]
                if not len(at):
                    continue
                doc = of[which]
                here = first[doc] + at
                index = pa.array(lo + doc)
                window = texts.digests(joined, word[here], stop[here + length - 1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(at.astype(np.int32)), pa.array(window[:, 0]), pa.array(window[:, 1])], ["uid", "doc_id", "begin", "h1", "h2"])

    kind = checked.schema["doc_id"].dataType.simpleString()
    return scratch.map_arrow(checked.select("uid", "doc_id", "text", "check"), read, f"uid long, doc_id {kind}, begin int, h1 long, h2 long")


def _merged(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, begin and end of the maximal stretches that the given ones cover; touching ones are one."""
    if not len(doc):
        return doc, begin, end
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    # Ends so far inside each text, as texts follow each other on one line.
    line = int(end.max()) + 2
    reach = np.maximum.accumulate(doc * line + end)
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] * line + begin[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(doc)) - 1
    return doc[new], begin[new], reach[last] - doc[new] * line


def _keep(marked: DataFrame, length: int) -> DataFrame:
    """n_removed, spans and the hash of the kept words, from each row's repeated runs."""
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in texts.blocks(batch.column(1)):
                raw, rows = data.tobytes(), hi - lo
                part = batch.column(2).slice(lo, rows)
                of = np.repeat(np.arange(rows), part.value_lengths().to_numpy(zero_copy_only=False))
                run = part.flatten()
                begin, n = (run.field(c).to_numpy().astype(np.int64) for c in ("begin", "n"))
                doc, begin, end = _merged(of, begin, begin + n + length - 1)
                first = np.searchsorted(doc, np.arange(rows + 1))
                shas = []
                for i in range(rows):
                    tokens, kept, at = raw[offsets[i] : offsets[i + 1]].split(), [], 0
                    for k in range(first[i], first[i + 1]):
                        kept += tokens[at : begin[k]]
                        at = end[k]
                    shas.append(hashlib.sha256(b" ".join(kept + tokens[at:])).hexdigest())
                pairs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (begin, end)], fields=list(span))
                spans = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pairs)
                removed = np.bincount(doc, end - begin, rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), pa.array(removed), pa.array(shas, pa.string()), spans], ["uid", "n_removed", "kept_sha256", "spans"])

    return scratch.map_arrow(marked.select("uid", "text", "runs"), read, "uid long, n_removed long, kept_sha256 string, spans array<struct<begin: int, end: int>>")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, anchor: int = 12, rows: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans of each row; with ``rows``, its place as well.

    spans: the maximal stretches of words (begin, end) whose windows of ``length``
    words all also start in a document with a smaller doc_id; those words are
    removed. Null doc_id counts as larger than any other; rows with one doc_id, which
    tie, don't remove each other's words, and repeated rows are rows of their own. Null
    or empty texts have no words; texts of any length are read whole. An empty table
    gives an empty result; other columns, whatever their names, are not read. ``docs``
    may be any DataFrame: rows that are not those of one Parquet table are written first.
    """
    if not 1 <= anchor <= length:
        raise ValueError("anchor must be from 1 to length")
    docs = scratch.placed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    slim = scratch.materialize(scan(docs, "doc_id", "text", length, anchor), "runs")
    runs = slim.select("uid", "doc_id", F.inline(F.arrays_zip("anchor", "block1", "block2", "begin", "n")))

    block = ["anchor", "block1", "block2"]
    # Blocks that several rows hold, or whose anchor stands in several blocks.
    blocks = runs.groupBy(*block).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("held"))
    blocks = scratch.materialize(blocks, "blocks")
    mixed = blocks.groupBy("anchor").agg(F.count(F.lit(1)).alias("differ")).where("differ > 1")
    known = scratch.materialize(blocks.join(mixed, "anchor", "left").where("held > 1 or differ > 1").select(*block, "least", (F.coalesce("differ", F.lit(1)) > 1).alias("open")), "known")
    scratch.drop(blocks)
    later = F.col("least").isNotNull() & (F.col("doc_id").isNull() | (F.col("least") < F.col("doc_id")))
    found = runs.join(known, block).select("uid", "begin", "n", later.alias("repeated"), "open").where("repeated or open")
    run = F.struct("begin", "n")
    per_row = found.groupBy("uid").agg(F.collect_list(F.when(F.col("repeated"), run)).alias("sure"), F.collect_list(F.when(~F.col("repeated"), run)).alias("check"))
    plain = slim.select("uid", "row", "doc_id", "n_words", "sha")
    per_row = per_row.join(plain.select("uid", "row", "doc_id", "n_words"), "uid")
    text = scratch.identified(docs, "row").select("row", "text")
    # Texts are shuffled but not sorted: the lists are the side that is hashed.
    candidates = scratch.materialize(text.join(per_row.hint("shuffle_hash"), "row").drop("row"), "candidates")

    windows = scratch.materialize(_hash_windows(candidates.where(F.size("check") > 0), length), "windows")
    # Written, so that the join has two plain shuffles and can split a window that very many documents hold.
    first = scratch.materialize(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("held")).where("held > 1").drop("held"), "first")
    hit = windows.join(first, ["h1", "h2"]).where(later).select("uid", F.struct("begin", F.lit(1).alias("n")).alias("run"))
    extra = hit.groupBy("uid").agg(F.collect_list("run").alias("extra"))

    none = F.array().cast("array<struct<begin: int, n: int>>")
    marked = candidates.join(extra.hint("shuffle_hash"), "uid", "left").select("uid", "text", F.concat("sure", F.coalesce("extra", none)).alias("runs")).where(F.size("runs") > 0)
    cut = scratch.materialize(_keep(marked, length), "cut")
    scratch.drop(known, candidates, windows, first)
    return plain.join(cut, "uid", "left").select(*["row"] * rows, "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<struct<begin: int, end: int>>")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, anchor: int = 12) -> DataFrame:
    """``docs`` with the repeated words taken out of their texts, and the rest joined by single spaces.

    A text without repeated words stays as it is; one of which all words are
    repeated becomes empty. All else is as in ``substring_dedup``.
    """
    docs = scratch.placed(docs)
    row, spans = scratch.free_name("row", docs), scratch.free_name("spans", docs)
    found = substring_dedup(docs, id_col, text_col, length, anchor, rows=True).where("n_removed > 0").select(F.col("row").alias(row), F.col("spans").alias(spans))
    joined = scratch.identified(docs, row).join(found, row, "left")
    tokens = F.split(F.btrim(F.col(text_col), F.lit(texts.SEPARATORS.decode())), texts.WORDS_SPLIT)
    kept = F.filter(tokens, lambda w, i: ~F.exists(F.col(spans), lambda s: (s["begin"] <= i) & (i < s["end"])))
    cut = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.concat_ws(" ", kept))
    return joined.withColumn(text_col, cut).select(*[F.col(f"`{c}`") for c in docs.columns])
