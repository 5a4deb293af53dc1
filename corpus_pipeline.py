"""A corpus from ``documents``: quality, exact and near duplicates, mixture, packing.

Each stage takes all rows that the one before it kept and acts on its decisions;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, mixing, near_copies, packing, quality, scratch

#: Rows of a decision table that may be broadcast, of about 20 bytes each; a longer one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def _by_row(docs: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with ``decisions`` (row and what else) on the row's place in its file."""
    few = decisions.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    row = scratch.free_name("row", docs, decisions)
    decisions = decisions.withColumnRenamed("row", row)
    # Beyond that, decisions are the side that is hashed, so that texts are not sorted.
    return scratch.identified(docs, row).join(F.broadcast(decisions) if few else decisions.hint("shuffle_hash"), row, how).drop(row)


def _without(docs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    return _by_row(docs, scratch.materialize(found.select("row"), name), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of being good is under one half go.

    Null and empty texts are judged by figures that are all 0, very long ones are read
    whole, and texts at one half stay. Equal rows share a verdict; rows stay as often as
    they stood. An empty table gives an empty one, and all columns, whatever their names,
    are kept.
    """
    docs = scratch.placed(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, labels, host="source", path="lang")
    return _without(docs, scored.where(~F.col("kept")), "rejected")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without their white space one stays: the longest, then the smallest doc_id.

    Null and empty texts are equal to each other, very long ones are compared whole, and
    of rows that tie in all this the first by place stays. An empty table gives an empty
    one, and all columns, whatever their names, are kept.
    """
    docs = scratch.placed(docs)
    return _without(docs, exact_dedup.exact_dedup(docs).where(~F.col("kept")), "copies")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, texts with four fifths of their five-word shingles in common, the smallest doc_id stays.

    Null and empty texts are near each other and nothing else, very long ones are compared
    whole, null doc_ids come last, and of rows with one doc_id the first by place stays.
    Repeated rows are near copies. An empty table gives an empty one, and all columns,
    whatever their names, are kept.
    """
    docs = scratch.placed(docs)
    return _without(docs, near_copies.near_copies(docs, shingle=5, similarity=0.8).where(~F.col("keeper")), "near")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mixture takes it; those that it doesn't take go.

    Null and empty texts have no words and stand as often as their source's rate says, or
    not at all in a source without words; very long texts count whole. Which of equal rows
    stand once more is decided by their place. An empty table gives an empty one, and all
    columns, whatever their names, are kept.
    """
    docs = scratch.placed(docs)
    copies, copy = scratch.free_name("copies", docs), scratch.free_name("copy", docs)
    mixed = mixing.mix(docs).where("copies > 0").select("row", F.col("copies").cast("int").alias(copies))
    taken = _by_row(docs, scratch.materialize(mixed, "copies"), "inner")
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each a sequence whose length is a power of two.

    Null and empty texts are the end id alone, very long ones are cut into as many pieces
    as they need, equal and repeated rows are packed each for itself, and an empty table
    gives no piece. Columns beside doc_id and text are not read.
    """
    return packing.pack(docs, most=1024, end_id=0)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokens, fingerprints and rounding are beyond SQL; tests compare run() with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next.

    What a stage wrote on its way is deleted once its result is written, and that
    once the next stage's is.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before = scratch.mark()
        out = scratch.materialize(stage(spark, docs, sf_dir), f"stage-{i}")
        scratch.release(before, out)
        scratch.drop(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)
