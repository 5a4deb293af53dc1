"""Document fingerprints by one-permutation MinHash, in built-in functions only.

Each five-word shingle is hashed once; the hash's top bits choose a bin and the
smallest hash of a bin is its value. An empty bin takes the value of the bin that
its own universal hash draws, trying again while it draws empty bins (optimal
densification), so the choice depends on nothing but which bins are empty. The
low bits of all values are packed. Two fingerprints agree in a bin by chance with
probability 2^-bits; the likeness is corrected for that.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch, texts

BINS, BITS, SHINGLE = 256, 4, 5
#: Draws of an empty bin before it ranks all bins that have a value.
_DRAWS = 12
#: A table of ranges is broadcast up to so many rows, about 30 bytes each; a longer one is joined by a shuffle.
_BROADCAST_ROWS = 100_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _shingles(text: Column, k: int) -> Column:
    """Hashes of all shingles; of the whole sequence if it has up to ``k`` words; of nothing if none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(texts.SEPARATORS.decode()))

    def hashed(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(F.size(w) <= k, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(runs)

    return let(F.split(body, texts.WORDS_SPLIT), hashed)


def _bin(h: Column, bins: int) -> Column:
    return F.shiftrightunsigned(h, 64 - int(math.log2(bins))).cast("int")


def _densified(first: Column, bins: int) -> Column:
    """The value of each bin; first: the smallest hash of each bin that has one."""

    def fill(dense: Column) -> Column:
        def drawn(i: Column) -> Column:
            draws = [F.get(dense, F.pmod(F.xxhash64(i, F.lit(a)), F.lit(bins)).cast("int")) for a in range(_DRAWS)]
            ranked = F.array_min(F.transform(first, lambda h: F.struct(F.xxhash64(i, F.lit("rank"), _bin(h, bins)).alias("rank"), h.alias("value"))))["value"]
            return F.coalesce(F.get(dense, i), *draws, ranked)

        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), drawn)

    by_bin = F.map_from_arrays(F.transform(first, lambda h: _bin(h, bins)), first)
    dense = let(by_bin, lambda m: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: m[i]))
    return let(dense, fill)


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> Column:
    """Packed low bits of all bins, as longs; texts of equal words have equal ones."""
    if bins & (bins - 1) or 64 % bits or bins * bits % 64:
        raise ValueError("bins must be a power of two, and whole longs must be filled")
    per = 64 // bits

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda h, i: (i == 0) | (_bin(h, bins) != _bin(F.get(s, i - 1), bins)))

    values = let(let(F.sort_array(_shingles(text, k)), firsts), lambda f: _densified(f, bins))
    low = F.lit((1 << bits) - 1).cast("long")

    def packed(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(bins // per - 1)), lambda q: F.aggregate(F.slice(v, q * per + 1, per), F.lit(0).cast("long"), lambda acc, h: F.shiftleft(acc, bits).bitwiseOR(h.bitwiseAND(low))))

    # A value that several bins share is hashed with the bin, so that their low bits agree by chance one by one.
    return let(let(values, lambda v: F.transform(v, lambda h, i: F.xxhash64(h, i))), packed)


def as_hex(fp: Column) -> Column:
    return F.concat_ws("", F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard likeness of the shingle sets, 0 to 1, without chance agreement."""
    ones = sum(1 << s for s in range(0, 64, bits))
    mask = F.lit(ones - (1 << 64) if ones >> 63 else ones).cast("long")

    def unequal(x: Column) -> Column:
        folded = x
        for s in range(1, bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        return F.bit_count(folded.bitwiseAND(mask))

    apart = F.aggregate(F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    chance = 2.0**-bits
    return F.greatest(F.lit(0.0), ((F.lit(bins) - apart) / float(bins) - chance) / (1 - chance))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, k: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (hex) of each row; null text is empty."""
    return docs.select(F.col(id_col).alias("doc_id"), as_hex(fingerprint(F.col(text_col), bins, bits, k)).alias("fingerprint"))


def _search(heads: list, some: Column, doc_id: Column, tie: Column) -> Column:
    """How many of ``heads``, but the first, are at or before the row, by binary search."""
    bounds = heads[1:]
    if not bounds:
        return F.lit(0)
    filler = next((h["doc_id"] for h in bounds if h["doc_id"] is not None), None)
    somes, ties = F.lit([h["some"] for h in bounds]), F.lit([h["tie"] for h in bounds])
    ids = F.lit([filler if h["doc_id"] is None else h["doc_id"] for h in bounds]) if filler is not None else None

    def reached(i: Column) -> Column:
        tied = F.get(ties, i) <= tie
        beyond = F.lit(True) if ids is None else (F.get(ids, i) < doc_id) | ((F.get(ids, i) == doc_id) & tied)
        return F.when(some, ~F.get(somes, i) | beyond).otherwise(~F.get(somes, i) & tied)

    steps = F.lit([1 << s for s in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= len(bounds)) & reached(p + s - 1), p + s).otherwise(p))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and fp of each row, and next_text and next_fp of the row that follows by doc_id.

    After the last row comes the first; null doc_ids come first, and rows with one
    doc_id follow each other by a hash of their place in the file. Rows are dealt by
    eight times as many ranges of both as there are shuffle partitions, so that ids
    that repeat, or are missing, are many ranges' work; the first row of each range
    is repeated at the end of the one before. Texts are shuffled once and nothing is
    ordered in one task. Only one key per range reaches the driver.
    """
    spark = docs.sparkSession
    docs = scratch.placed(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    place = [F.col("doc_id").isNotNull().alias("some"), F.xxhash64("row.place").alias("tie")]
    keys = scratch.identified(docs.select("doc_id"), "row").select("doc_id", "row", *place)
    order = ["some", "doc_id", "tie", "row"]
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = keys.repartitionByRange(parts, "some", "doc_id", "tie").groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*order)).alias("head"))
    heads = [r["head"] for r in sorted(first.collect(), key=lambda r: r["part"])]

    base = scratch.spread(scratch.identified(docs, "row")).select("doc_id", "text", "row", *place)
    at = _search(heads, F.col("some"), F.col("doc_id"), F.col("tie"))
    own = base.withColumn("range", at).withColumn("ghost", F.lit(0))
    if heads:
        before = [((i - 1) % len(heads), tuple(h["row"]), 1) for i, h in enumerate(heads)]
        table = spark.createDataFrame(before, "range int, row struct<file: long, place: long>, ghost int")
        if len(before) <= _BROADCAST_ROWS:
            table = F.broadcast(table)
        own = own.unionByName(base.join(table, "row"))
    marked = own.withColumn("fp", fingerprint(F.col("text")))
    over = W.partitionBy("range").orderBy("ghost", *order)
    following = marked.withColumn("next", F.lead(F.struct("text", "fp")).over(over))
    return following.where("ghost = 0").select("doc_id", "text", "fp", F.col("next.text").alias("next_text"), F.col("next.fp").alias("next_fp"))


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last quarter replaced by as much of the next text's start."""
    q = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - q), F.substring(following, F.lit(1), q))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row.

    Null text is empty; texts without words share one fingerprint, and are alike
    only to each other. Texts of any length are read whole. Rows with one doc_id tie and
    follow each other in an order of their own (see ``with_next``); repeated rows are
    rows of their own, an empty table gives an empty result, and other columns,
    whatever their names, are not read. ``docs`` may be any DataFrame: rows that are not
    those of one Parquet table are written first.
    """
    rows = with_next(docs, id_col, text_col).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    both = let(fingerprint(F.col("edited")), lambda f: F.struct(as_hex(f).alias("hex"), likeness(F.col("fp"), f).alias("near")))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_hex(F.col("fp")).alias("fingerprint"), both.alias("both"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", F.col("both.hex").alias("edited_fingerprint"), F.col("both.near").alias("near_edited"), "near_next"
    )
