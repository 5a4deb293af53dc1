"""Sharding by a hierarchical weighted hash tree.

A document descends region, rack and shard. At each node it draws, for every
child, ``-ln(u) / weight`` with u in (0, 1) from a hash of its key and the child's
name, and takes the child with the smallest draw, so a child gets its weight's
share. If one child's weight changes, only draws for that child change, and rows
move only into or out of its subtree.

Everything is built-in column functions: the draws are part of the scan, and the
only shuffle moves ids and sizes, never texts.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks, scratch

#: Shards of a full region: racks times shards of a rack.
RACKS, PER_RACK = 2, 4
#: Bits of a hash in a draw.
_BITS = 52


def topology(shards: int, base: int | None = None) -> list[tuple[str, str, int, float]]:
    """(region, rack, shard, weight) of each shard.

    The first ``base`` shards (all if None) fill regions of RACKS racks of PER_RACK.
    Each later shard stands in a region of its own, so that adding it changes no
    weight but its own subtree's and takes rows only into itself.
    """
    base = shards if base is None else min(base, shards)
    whole = RACKS * PER_RACK
    out = [(f"r{s // whole}", f"r{s // whole}k{s % whole // PER_RACK}", s, 1.0) for s in range(base)]
    return out + [(f"x{s}", f"x{s}k0", s, 1.0) for s in range(base, shards)]


def _draw(key: Column, child: str, weight: float) -> Column:
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(child)), 64 - _BITS).cast("double")
    return -F.log((h + 0.5) / float(1 << _BITS)) / F.lit(float(weight))


def _pick(key: Column, children: dict[str, float]) -> Column:
    if len(children) == 1:
        return F.lit(next(iter(children)))
    return F.least(*[F.struct(_draw(key, c, w).alias("draw"), F.lit(c).alias("child")) for c, w in children.items()])["child"]


def _descend(key: Column, tree: list[tuple[str, str, int, float]]) -> Column:
    regions: dict[str, float] = defaultdict(float)
    racks: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    shards: dict[str, dict[str, float]] = defaultdict(dict)
    for region, rack, shard, weight in tree:
        regions[region] += weight
        racks[region][rack] += weight
        shards[rack][f"s{shard}"] = weight

    def branch(picked: Column, of: dict[str, Column]) -> Column:
        out = None
        for name, then in of.items():
            out = F.when(picked == name, then) if out is None else out.when(picked == name, then)
        return out

    leaf = {rack: F.substring(_pick(key, c), 2, 9).cast("int") for rack, c in shards.items()}
    rack_of = {region: branch(_pick(key, c), {k: leaf[k] for k in c}) for region, c in racks.items()}
    return branch(_pick(key, regions), rack_of)


def assign(docs: DataFrame, tree: list[tuple[str, str, int, float]], grown: list[tuple[str, str, int, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of each row.

    The key of the draws is doc_id alone: rows with one doc_id share a shard, null
    doc_id counting as a key of its own. size: UTF-8 bytes and 1; null text is
    empty, and texts of any length count whole. slot: 0, 1, ... in each shard, by a hash
    of doc_id, text_crc32 and the row's place, then these themselves, so that rows that
    share a doc_id, or have none, are numbered by as many tasks as any others. Repeated
    rows tie but for their place and take slots of their own. grown_shard: the shard in
    ``grown``, null without it. Empty tables give none; other columns aren't read.
    ``docs`` may be any DataFrame: rows that are not those of one Parquet table are
    written first.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col("doc_id")
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    shard = _descend(key, tree).alias("shard")
    rows = scratch.identified(docs.select(F.col(id_col).alias("doc_id"), body.alias("body")), "row")
    rows = scratch.spread(rows).select("row", "doc_id", (F.octet_length("body") + 1).cast("long").alias("size"), F.crc32("body").alias("text_crc32"))
    more = (_descend(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard")
    # Written, so that texts are read once for counting and numbering.
    rows = scratch.materialize(rows.select("doc_id", "size", "text_crc32", shard, more, F.col("row.place").alias("place"), F.col("row.file").alias("file")), "sizes")
    by = ["doc_id", "text_crc32", "place"]
    return ranks.positions(rows, rows, ["shard"], by, [*by, "size", "file"], parts, "slot").drop("place", "file")


def place(docs: DataFrame, tree: list[tuple[str, str, int, float]], id_col: str = "doc_id", out: str = "shard") -> DataFrame:
    """``docs`` with each row's shard; a map, without a shuffle."""
    return docs.withColumn(out, _descend(F.col(id_col), tree))


def write(docs: DataFrame, path: str, tree: list[tuple[str, str, int, float]], files: int = 8, id_col: str = "doc_id") -> None:
    """Parquet files of each shard below ``path/shard=N``, about ``files`` of them, dealt by a hash of the key."""
    placed = place(docs, tree, id_col)
    n = len(tree) * files
    placed.repartition(n, F.col("shard"), ranks.spread(files, id_col)).write.partitionBy("shard").parquet(path)
