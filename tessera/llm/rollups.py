"""Token counts as delta-maintained rollups.

A store keeps additive totals of documents and tokens by source, language and
tokenizer version. A batch of changes (inserts, deletes and revised counts) is
turned into signed deltas, summed by key, and added by one commit. A commit is one
rename of a written folder to a name made of the batch's id, so a batch is in the
store wholly or not at all, and committing it again, after a retry or by a second
writer, changes nothing. Totals are the sums over the committed folders;
compaction folds them into one folder and remembers the ids that it holds.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch, texts
from .packing import encoder

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def changes(old: DataFrame | None, new: DataFrame | None) -> DataFrame:
    """Signed rows of a batch: old rows leave, new rows enter; a revised row is in both.

    Both have KEYS and tokens. Rows are independent of each other, so a revision
    needs no join: its old and new counts, and its old and new keys, cancel or add
    up in the sums.
    """
    parts = [df.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.coalesce(F.col("tokens"), F.lit(0)) * sign).cast("long").alias("n_tokens")) for df, sign in ((old, -1), (new, 1)) if df is not None]
    if not parts:
        raise ValueError("a batch needs old or new rows")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


class Store:
    """Totals below ``path``, a folder that all executors share.

    Null keys are groups of their own. Groups whose documents and tokens are both 0
    are left out of the totals. An empty batch can be committed. The path's file system
    must rename a folder as one step, as HDFS and local ones do; object stores don't.
    Totals that were asked for before ``compact`` may read folders that it deletes, so
    ask again after it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _name(self, batch: str) -> str:
        return f"batch={hashlib.sha256(batch.encode()).hexdigest()}"

    def _staged(self) -> str:
        """A new folder in the store's own file system, so that a rename can move it."""
        return f"{self.path}/staged/{uuid.uuid4().hex}"

    def _rename(self, source: str, target: str) -> bool:
        """Whether ``source`` became ``target``; False if that was there before."""
        fs, to = scratch.filesystem(self.spark, target)
        fs.mkdirs(to.getParent())
        try:
            if not fs.exists(to) and fs.rename(scratch.filesystem(self.spark, source)[1], to):
                # A rename into a folder that another writer made just now lands below it.
                nested = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to, source.rsplit("/", 1)[1])
                if fs.exists(nested):
                    fs.delete(nested, True)
                    return False
                return True
        except Py4JJavaError:
            if not fs.exists(to):
                raise
        return False

    def _folders(self) -> list[str]:
        """The newest compacted folder and the batches that it doesn't hold."""
        fs, p = scratch.filesystem(self.spark, f"{self.path}/log")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        merged = max((n for n in names if n.startswith("merged=")), default=None)
        held = self._held(merged) if merged else set()
        return [n for n in names if n.startswith("batch=") and n not in held] + ([merged] if merged else [])

    def _held(self, merged: str) -> set[str]:
        return {r["name"] for r in self.spark.read.schema("name string").parquet(f"{self.path}/log/{merged}/held").collect()}

    def committed(self, batch: str) -> bool:
        fs, p = scratch.filesystem(self.spark, f"{self.path}/log/{self._name(batch)}")
        return fs.exists(p) or any(self._name(batch) in self._held(n) for n in self._folders() if n.startswith("merged="))

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add a batch's signed rows; False, and no change, if the batch is in the store already."""
        if self.committed(batch):
            return False
        sums = signed.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        staged = self._staged()
        sums.write.parquet(f"{staged}/totals")
        done = self._rename(staged, f"{self.path}/log/{self._name(batch)}")
        if not done:
            fs, p = scratch.filesystem(self.spark, staged)
            fs.delete(p, True)
        return done

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens."""
        folders = self._folders()
        if not folders:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/log/{n}/totals" for n in folders])
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Fold all folders into one. A writer that fails midway leaves the store as it was."""
        folders = self._folders()
        old = [n for n in folders if n.startswith("merged=")]
        held = {n for n in folders if n.startswith("batch=")} | {x for n in old for x in self._held(n)}
        staged = self._staged()
        self.totals().write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(n,) for n in sorted(held)], "name string").write.parquet(f"{staged}/held")
        turn = int(old[0].partition("=")[2]) + 1 if old else 0
        if self._rename(staged, f"{self.path}/log/merged={turn:012d}"):
            for n in folders:
                fs, p = scratch.filesystem(self.spark, f"{self.path}/log/{n}")
                fs.delete(p, True)


def count_tokens(docs: DataFrame, tokenizers: Sequence[str] = ("byte_bpe_50k", "words"), text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """source, lang, tokenizer and tokens: a row per document and tokenizer version.

    Versions are the byte-level BPE files of the public tokenizers by their name, and
    ``words``, runs of ``[^\\x20\\x09-\\x0D]+``. Null or empty texts have 0 tokens, and
    texts of any length are counted whole. Repeated rows count each for itself, so there
    are no ties to break. An empty table gives no rows; other columns, whatever their
    names, are not read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = {t: encoder(f"{t}.json", f"{t}.tiktoken") for t in tokenizers if t != "words"}
        for batch in batches:
            per: list[list[np.ndarray]] = [[] for _ in tokenizers]
            for _, _, data, offsets in texts.blocks(batch.column(2)):
                raw = data.tobytes()
                for out, t in zip(per, tokenizers, strict=True):
                    out.append(np.diff(texts.words(data, offsets)[2]) if t == "words" else np.array([len(bpe[t].ids(raw[a:b].decode())) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64))
            for counts, t in zip(per, tokenizers, strict=True):
                n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t] * len(n), pa.string()), pa.array(n, pa.int64())], ["source", "lang", "tokenizer", "tokens"])

    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return scratch.map_arrow(scratch.spread(rows), read, "source string, lang string, tokenizer string, tokens long")


def estimate_tokens(docs: DataFrame, tokenizers: Sequence[str] = ("byte_bpe_50k", "words"), per_token: float = 4.0, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Provisional rows of ``count_tokens`` by code points alone, for a batch that a later one revises."""
    tokens = F.ceil(F.length(F.coalesce(F.col(text_col), F.lit(""))) / per_token).cast("long")
    return docs.select(F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.explode(F.array(*map(F.lit, tokenizers))).alias("tokenizer"), tokens.alias("tokens"))
