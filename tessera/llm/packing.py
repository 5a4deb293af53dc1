"""Packing by power-of-two decomposition.

A document's tokens are cut into pieces whose lengths are powers of two: as many
of the full length as fit, then the binary digits of the rest. Each piece is a
sequence of its own and pieces of one length are numbered together, so a batch
drawn from one bucket has equal lengths, needs no padding, and no sequence holds
tokens of two documents.
"""

from __future__ import annotations

import base64
import importlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks, scratch, texts

_PROBE = "It's 42 naïve words,\n\n  and (more) – 日本語 'll\t\x00 end  "
_loaded: dict[tuple[str, str | None], object] = {}


class Encoder:
    """Token ids of the tokenizer in ``path``, as the tokenizers library gives them.

    fast: a file of the same vocabulary as ranks. The same merges by a faster
    library then serve texts that hold none of the tokenizer's added tokens; it is
    used only if it agrees on a probe, and tests compare both on whole tables.
    """

    def __init__(self, path: str, fast: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_padding()
        self.slow.no_truncation()
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.quick = None
        if fast:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(fast, "rb") as lines:
                ranked = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranked, special_tokens={})
            if quick.encode_ordinary(_PROBE) == self._slow(_PROBE):
                self.quick = quick

    def _slow(self, text: str) -> list[int]:
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if self.quick is None or any(t in text for t in self.added):
            return self._slow(text)
        return self.quick.encode_ordinary(text)


def encoder(vocabulary: str, fast: str | None = None) -> Encoder:
    """The worker's own encoder for these files of the public tokenizers."""
    if (vocabulary, fast) not in _loaded:
        path = importlib.import_module("public_tokenizers").path
        _loaded[vocabulary, fast] = Encoder(path(vocabulary), path(fast) if fast else None)
    return _loaded[vocabulary, fast]


def lengths(n: int, most: int) -> list[int]:
    """Powers of two that add up to n, none over most, long ones first."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 1024, end_id: int = 0, vocabulary: str = "byte_bpe_50k.json", fast: str | None = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and row of each piece; row tells repeated rows apart."""
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, fast)
        for batch in batches:
            for lo, hi, data, offsets in texts.blocks(batch.column(2)):
                raw, index, start, length, crc, total = data.tobytes(), [], [], [], [], []
                for i in range(hi - lo):
                    ids = np.array([*enc.ids(raw[offsets[i] : offsets[i + 1]].decode()), end_id], "<u4").tobytes()
                    at, n = 0, len(ids) // 4
                    for size in lengths(n, most):
                        index.append(lo + i)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                        total.append(n)
                        at += size
                took = pa.array(index, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(1).take(took), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return scratch.map_arrow(scratch.spread(rows), cut, f"row long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, parts: int | None = None, **options) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sequence_id runs from 0 without gaps, length by length, so that a bucket is a
    range of ids; offset is 0, as each piece is a sequence. A null or empty text is
    the end id alone, and a text of any length is cut into as many pieces as it needs.
    Repeated rows, which tie, and null ids are documents like any other. An empty table
    gives an empty result; other columns aren't read.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = scratch.materialize(pieces(docs, **options), "pieces")
    out = ranks.positions(cut, cut, ["length"], ["row", "start"], ["doc_id", "start", "row"], parts, "sequence_id", running=True)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
