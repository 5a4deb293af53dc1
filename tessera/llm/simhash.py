"""SimHash near-duplicates by self-joins of binary tries.

A fingerprint's bits are a path in a binary trie. A self-join visits pairs of
nodes together, adds up the bits in which their paths differ, and drops a pair as
soon as that is over the budget; pairs of small subtrees are compared outright.

Fingerprints that differ in at most b bits agree on one of b + 1 blocks, so the
trie is built once per block with that block's bits first, and each subtree below
them is a task's work; one of very many fingerprints is cut into parts, and each pair
of parts is a task's. A task returns a spanning forest of the links it found,
not the links, so a dense group of n fingerprints costs n rows. The forests are
joined by alternating star contractions in written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, texts

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Pairs of subtrees with at most so many pairs of leaves are compared outright.
_OUTRIGHT = 64
#: Node pairs and leaf pairs held at once.
_HELD = 1 << 20


def shingle_hashes(raw: bytes, k: int, seed: int) -> list[int]:
    """XXH64 of each run of ``k`` lower-cased words joined by a space; of all words if fewer."""
    tokens = raw.translate(_LOWER).split()
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) <= k:
        return [xxhash.xxh64_intdigest(joined, seed)]
    ends = [e - 1 for e in accumulate(len(t) + 1 for t in tokens)]
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :], strict=False)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """row, doc_id and the 64-bit fingerprint (as a signed long) of each row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offsets in texts.blocks(batch.column(2), 1 << 17):
                raw, hashes, counts = data.tobytes(), [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    h = shingle_hashes(raw[a:b], shingle, seed)
                    hashes += h
                    counts.append(len(h))
                n = np.array(counts)
                fp = np.zeros(len(n), np.uint64)
                if hashes:
                    ones = np.zeros((len(n), 64), np.int64)
                    full = np.flatnonzero(n)
                    values = np.array(hashes, np.uint64)
                    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                    ones[full] = np.add.reduceat(bits, (np.cumsum(n) - n)[full], axis=0, dtype=np.int32)
                    fp = np.packbits(2 * ones > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
                out.append(fp)
            fp = np.concatenate(out) if out else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))], ["row", "doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = scratch.identified(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "row").select("row", "doc_id", "text")
    return scratch.map_arrow(scratch.spread(rows), compute, f"row struct<file: long, place: long>, doc_id {kind}, fp long")


class _Forest:
    """Union by smallest index, on whole arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.root[u], self.root[v]
            apart = a != b
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            if not len(u):
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _leaves(v: np.ndarray, pairs: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked leaves of node pairs (columns: first node's range, second's), a bounded number at once."""
    size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    at = 0
    while at < len(pairs):
        total = np.cumsum(size[at:])
        n = max(1, int(np.searchsorted(total, _HELD, "right")))
        p, s = pairs[at : at + n], size[at : at + n]
        at += n
        which = np.repeat(np.arange(n), s)
        k = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
        width = (p[:, 3] - p[:, 2])[which]
        i, j = p[which, 0] + k // width, p[which, 2] + k % width
        near = (i < j) & (np.bitwise_count(v[i] ^ v[j]) <= budget)
        yield i[near], j[near]


def trie_links(v: np.ndarray, top: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indices into ``v`` (sorted) with equal ``top`` first bits and at most ``budget`` different ones."""
    if len(v) < 2:
        return
    edge = np.flatnonzero(np.diff(v >> np.uint64(64 - top), prepend=~v[:1])) if top else np.zeros(1, np.int64)
    edge = np.unique(np.concatenate(([0], edge)))
    ends = np.append(edge[1:], len(v))
    stack = [(top, np.stack([edge, ends, edge, ends, np.zeros(len(edge), np.int64)], axis=1))]
    while stack:
        depth, nodes = stack.pop()
        same = nodes[:, 0] == nodes[:, 2]
        na, nb = nodes[:, 1] - nodes[:, 0], nodes[:, 3] - nodes[:, 2]
        nodes = nodes[(na > 0) & (nb > 0) & (nodes[:, 4] <= budget) & ~(same & (na < 2))]
        small = ((nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2]) <= _OUTRIGHT) | (depth >= 64)
        yield from _leaves(v, nodes[small], budget)
        nodes = nodes[~small]
        if not len(nodes):
            continue
        if len(nodes) > _HELD:
            half = len(nodes) // 2
            stack += [(depth, nodes[:half]), (depth, nodes[half:])]
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        clear = ~(bit | (bit - np.uint64(1)))
        a0, a1, b0, b1, diff = nodes.T
        am = np.searchsorted(v, (v[a0] & clear) | bit)
        bm = np.searchsorted(v, (v[b0] & clear) | bit)
        own = a0 == b0
        new = [np.stack(x, axis=1) for x in ((a0, am, b0, bm, diff), (am, a1, bm, b1, diff), (a0, am, bm, b1, diff + 1))]
        new.append(np.stack((am, a1, b0, bm, diff + 1), axis=1)[~own])
        stack.append((depth + 1, np.concatenate(new)))


def _dealt(distinct: DataFrame, first: list[int], bits: int, most: int) -> DataFrame:
    """b, k, i, j and t of each fingerprint in each block's table: turned so that the block leads, under its first bits.

    A subtree of over ``most`` fingerprints is cut into parts by a hash, and each fingerprint
    meets the others once for each pair (i, j) of parts that its own is of; i is null elsewhere.
    """
    fp = F.col("fp")
    turned = [F.struct(F.lit(b).alias("b"), (fp if not first[b] else F.shiftleft(fp, first[b]).bitwiseOR(F.shiftrightunsigned(fp, bits - first[b]))).alias("t")) for b in range(len(first) - 1)]
    least = min(b - a for a, b in pairwise(first))
    spread = distinct.select(F.inline(F.array(*turned))).withColumn("k", F.shiftrightunsigned("t", bits - least))
    # At most blocks * 2 ** least subtrees.
    held = spread.groupBy("b", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("b", "k", (F.ceil(F.col("n") * 2 / most)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("t"), F.col("parts")).cast("int")
    cut = spread.join(F.broadcast(held), ["b", "k"], "left").withColumn("own", own)
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least("own", p).alias("i"), F.greatest("own", p).alias("j")))
    none = F.array(F.struct(F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j")))
    return cut.select("b", "k", "t", F.inline(F.when(F.col("parts").isNull(), none).otherwise(every))).select("b", "k", "i", "j", "t")


def links(distinct: DataFrame, budget: int = 4, bits: int = 64, parts: int | None = None, most: int = 100_000) -> DataFrame:
    """Spanning forests (u, v) of all links between fingerprints, one per task; a task holds about ``most`` fingerprints of a subtree at once."""
    spark = distinct.sparkSession
    blocks = budget + 1
    first = [bits * b // blocks for b in range(blocks + 1)]
    widths = [first[b + 1] - first[b] for b in range(blocks)]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def forest(table: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        per, fps = {}, []
        for b in range(blocks):
            per[b] = np.unique(value[table == b])
            r = np.uint64(first[b])
            fps.append((per[b] >> r) | (per[b] << np.uint64(bits - first[b])) if first[b] else per[b])
        known = np.unique(np.concatenate(fps))
        joined = _Forest(len(known))
        for b in range(blocks):
            place = np.searchsorted(known, fps[b])
            for u, v in trie_links(per[b], widths[b], budget):
                joined.link(place[u], place[v])
        moved = np.flatnonzero(joined.root != np.arange(len(known)))
        return known[moved], known[joined.root[moved]]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of small subtrees come first and are one forest, each pair of parts is one of its own.
        key, held = None, []
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("b", "k", "i", "j")]
            cut = batch.column("i").is_valid().to_numpy(zero_copy_only=False)
            keys = np.stack([np.where(cut, np.nan_to_num(c.astype(np.float64), nan=-1), -1).astype(np.int64) for c in columns], axis=1)
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in pairwise([0, *new.tolist(), len(keys)]):
                if b > a and key != (at := tuple(keys[a].tolist())):
                    yield from given(held)
                    key, held = at, []
                held.append((columns[0][a:b], batch.column("t").to_numpy()[a:b].view(np.uint64)))
        yield from given(held)

    def given(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if held:
            u, v = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    dealt = _dealt(distinct, first, bits, most).repartition(parts, "b", "k", "i", "j")
    ordered = dealt.sortWithinPartitions(F.col("i").isNotNull(), *[F.when(F.col("i").isNotNull(), F.col(c)) for c in ("b", "k", "i", "j")])
    return scratch.map_arrow(ordered.select("b", "k", "i", "j", "t"), join, "u long, v long")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node and root (the smallest node it is linked with, over any number of links) of every node with a link.

    Alternates two contractions until nothing changes: each node hangs its larger
    neighbours, then itself and its smaller ones, below the smallest of them. Each
    round is a written table; the number of rounds is logarithmic in the longest
    chain. Neighbours are never gathered in one place: minima are partial
    aggregates, written so that the joins that bring them back have two plain
    shuffles and Spark can split a node with very many neighbours.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now, seen = scratch.materialize(ordered, "links"), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.materialize(large, "large")
        least = scratch.materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))).where("u <> v").distinct()
        new = scratch.materialize(small, "links")
        got = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now, low, large, least)
        now = new
        if tuple(got) == seen:
            break
        seen = tuple(got)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, budget: int = 4) -> DataFrame:
    """row, doc_id, fp, component_id, keeper and fingerprint of each row.

    Rows are linked if their fingerprints differ in at most ``budget`` bits;
    component_id is the smallest doc_id of all that can be reached, null only if all
    of those are null. keeper: true for one row of each component, the first by
    doc_id (null last). Null or empty texts, and such without words, have
    fingerprint 0 and are linked like any other; equal texts are always linked.
    Texts of any length are read whole. Repeated rows are rows of their own, and among
    those with one doc_id the first by place is the keeper. An empty table gives an
    empty result; other columns, whatever their names, are not read. ``docs`` may be any
    DataFrame: rows that are not those of one Parquet table are written first.
    """
    prints = scratch.materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("first")
    distinct = scratch.materialize(prints.groupBy("fp").agg(first), "distinct")
    roots = components(links(distinct.select("fp"), budget))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("best"))
    table = rooted.join(named, "root").select("fp", "best")
    return prints.join(table, "fp").select("row", "doc_id", "fp", F.col("best.id").alias("component_id"), (F.col("row") == F.col("best.row")).alias("keeper"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"))
