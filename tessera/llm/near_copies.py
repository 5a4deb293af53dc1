"""Near copies: texts whose word shingles are alike, decided on the shingles themselves.

Candidates come from two places. SimHash fingerprints of the shingles go through the
trie self-joins of ``simhash``. A pair at a likeness of 0.8 differs in about ten of 64
bits, more than a trie can be asked for without visiting nearly all pairs, so rows that
agree in one of ``bins / band`` bands of one-permutation MinHash values are candidates
as well: 0.8 ** band for each band, 99.7 % over 32 bands of 8, whatever the edit.

Every link is decided by the exact likeness of two shingle sets, and no group is ever
paired with itself:

1. Each row of a band's bucket is compared with the bucket's first row, and so are the
   links of the trie's forest. Copies of one text are mostly settled by that.
2. A bucket that still holds several groups is open: its rows outside its largest group
   are compared with all rows of other groups. They are dealt over blocks of bounded
   bytes, so a hot bucket is many tasks' work, and pairs that are joined by then or
   whose one-bit prints differ in too many bits are passed over.

Texts with equal shingle sets are one node throughout. Fingerprints, buckets and links
are written tables of numbers; sets are made only for rows that share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, simhash, texts

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Rows worked on at once, so that very many short texts take no more memory than long ones.
_ROWS = 1024
#: Rows that are wanted are broadcast up to so many, about 30 bytes each.
_BROADCAST_ROWS = 200_000
#: Bits by which one-bit prints of 256 bins may differ for an exact comparison. At a likeness
#: of 0.8 they differ by 25.6 on average, with a standard deviation of 4.8.
_BUDGET = 48


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's different shingles, in order, and where each text's start (one more at the end).

    Letters A-Z are lower-cased; a text of fewer words is one shingle, one without words has none.
    """
    data, n_docs = _LOWER[data], len(offsets) - 1
    starts, ends, first = texts.words(data, offsets)
    h, n = texts.word_hashes(data, starts, ends), np.diff(first)
    doc = np.repeat(np.arange(n_docs), n)
    begin = np.flatnonzero(np.arange(len(h)) + shingle <= first[1:][doc]) if len(h) else np.zeros(0, np.int64)
    runs = texts.chained(h, shingle)[begin] if len(begin) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < shingle))
    whole = np.array([int(texts.chained(h[first[i] : first[i + 1]], int(n[i]))[0]) for i in short], np.uint64)
    value = np.concatenate((runs, whole))
    owner = np.concatenate((doc[begin], short)) if len(begin) else short
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.searchsorted(owner[new], np.arange(n_docs + 1))


def _minima(value: np.ndarray, at: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hash in each of a row's bins, and which bins have one."""
    rows = len(at) - 1
    place = np.repeat(np.arange(rows), np.diff(at)) * bins + (value % np.uint64(bins)).astype(np.int64)
    low = np.full(rows * bins, ~np.uint64(0))
    np.minimum.at(low, place, value)
    full = np.zeros(rows * bins, bool)
    full[place] = True
    low[~full] = 0
    return low.reshape(rows, bins), full.reshape(rows, bins)


def filled(low: np.ndarray, full: np.ndarray, tries: int = 16) -> np.ndarray:
    """Each row's ``low`` with bins that are not ``full`` taken from full ones, by the same trials in all rows.

    A bin asks ``tries`` bins by hash, then the next full one after a last hash, so
    two rows agree in any bin with a chance of their likeness. Rows without a full
    bin stay as they are.
    """
    rows, bins = low.shape
    out, has = low.copy(), full.any(axis=1)
    at = np.flatnonzero(~full & has[:, None])
    for t in range(tries + 1):
        if not len(at):
            return out
        row, place = at // bins, at % bins
        asked = (texts.mix64(place.astype(np.uint64) * _GOLD + np.uint64(t + 1)) % np.uint64(bins)).astype(np.int64)
        if t == tries:
            # The next full bin at or after each place, round the row.
            after = np.where(np.tile(full, 2), np.arange(2 * bins), 2 * bins)
            after = np.minimum.accumulate(after[:, ::-1], axis=1)[:, ::-1] % bins
            asked = after[row, asked]
        good = full[row, asked]
        out.ravel()[at[good]] = low[row[good], asked[good]]
        at = at[~good]
    return out


def _bits(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """SimHash of each row's set: a bit is 1 if it is set in over half of the hashes."""
    out, n = np.zeros(len(at) - 1, np.uint64), np.diff(at)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(value.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, at[:-1][full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > n[full][:, None], axis=1).view(">u8").ravel()
    return out


def _rows(docs: DataFrame) -> DataFrame:
    return scratch.identified(docs, "row").select("row", "doc_id", "text")


def prints(docs: DataFrame, shingle: int = 5, bins: int = 256, band: int = 8) -> DataFrame:
    """row, doc_id, n (different shingles), twin (128 bits of the set), fp (SimHash) and bands of each row of (doc_id, text)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in texts.blocks(batch.column(2), 1 << 17, _ROWS):
                rows = hi - lo
                value, at = shingle_sets(data, offsets, shingle)
                banded = filled(*_minima(value, at, bins)).reshape(rows, bins // band, band)
                bands = np.tile(texts.mix64(np.arange(1, bins // band + 1, dtype=np.uint64)), (rows, 1))
                for i in range(band):
                    bands = texts.mix64(bands * _GOLD + banded[:, :, i])
                twins = [xxhash.xxh3_128_digest(value[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * (bins // band)), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), batch.column(1).slice(lo, rows), pa.array(np.diff(at)), pa.array(twins, pa.binary()), pa.array(_bits(value, at).view(np.int64)), lists],
                    ["row", "doc_id", "n", "twin", "fp", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return scratch.map_arrow(scratch.spread(_rows(docs)), compute, f"row struct<file: long, place: long>, doc_id {kind}, n long, twin binary, fp long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node and shingles (sorted hashes, packed) of the rows in ``wanted`` (row, node)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in texts.blocks(batch.column(1), 1 << 17, _ROWS):
                value, at = shingle_sets(data, offsets, shingle)
                packed = [value[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(packed, pa.binary())], ["node", "shingles"])

    few = wanted.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS
    rows = scratch.spread(_rows(docs)).join(F.broadcast(wanted) if few else wanted.hint("shuffle_hash"), "row")
    return scratch.map_arrow(rows.select("node", "text"), compute, "node long, shingles binary")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted sets; 1 for two empty ones."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(not len(b))
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[place] == a).sum())
    return both / (len(a) + len(b) - both)


def _alike(a: bytes, b: bytes, similarity: float) -> bool:
    if min(len(a), len(b)) < (similarity - 1e-9) * max(len(a), len(b)):
        return False
    return likeness(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= similarity - 1e-9


def verified(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``edges`` (u, v) whose sets are alike.

    The side that many edges share is joined first, while rows are two numbers.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            good = [i for i in range(batch.num_rows) if _alike(a[i].as_buffer(), b[i].as_buffer(), similarity)]
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    for end in ("v", "u"):
        edges = edges.join(sets.select(F.col("node").alias(end), F.col("shingles").alias(f"of_{end}")), end)
    return scratch.map_arrow(edges.select("u", "v", "of_u", "of_v"), check, "u long, v long")


def _one_bit(packed: list[bytes], bins: int = 256) -> np.ndarray:
    """A bit of each bin's smallest hash, as words of 64 bits; 0 for an empty bin."""
    out = np.zeros((len(packed), bins // 64), np.uint64)
    for lo in range(0, len(packed), 64):
        some = [np.frombuffer(p, np.uint64) for p in packed[lo : lo + 64]]
        at = np.cumsum([0, *map(len, some)])
        low, _ = _minima(np.concatenate(some), at, bins)
        out[lo : lo + 64] = np.packbits((low >> np.uint64(40)) & np.uint64(1) > 0, axis=1).view(np.uint64)
    return out


def _compare(rows: list[tuple], similarity: float) -> Iterator[tuple[int, int]]:
    """Links of one block (rest, node, label, shingles): rows of ``rest`` with others whose label isn't joined with theirs."""
    known = {label: i for i, label in enumerate(dict.fromkeys(r[2] for r in rows))}
    forest = simhash._Forest(len(known))
    label = np.array([known[r[2]] for r in rows])
    rest = np.array([r[0] for r in rows])
    size = np.array([len(r[3]) for r in rows])
    bits = _one_bit([r[3] for r in rows])
    for x in np.flatnonzero(rest):
        apart = ~rest & (forest.root[label] != forest.root[label[x]])
        apart &= np.minimum(size, size[x]) >= (similarity - 1e-9) * np.maximum(size, size[x])
        others = np.flatnonzero(apart)
        others = others[np.bitwise_count(bits[others] ^ bits[x]).sum(axis=1) <= _BUDGET]
        for y in others.tolist():
            if forest.root[label[x]] != forest.root[label[y]] and _alike(rows[x][3], rows[y][3], similarity):
                forest.link(label[[x]], label[[y]])
                yield rows[x][1], rows[y][1]


def open_links(members: DataFrame, sets: DataFrame, similarity: float, held_bytes: int = 1 << 22) -> DataFrame:
    """Links (u, v) inside buckets whose ``members`` (bucket, node, n, label) bear several labels.

    Buckets of two are left out, as their pair has been compared. What a task holds
    at once is the two sides of a block, about ``held_bytes`` each.
    """
    per = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    top = F.max(F.struct("k", "label"))["label"]
    per = per.groupBy("bucket").agg(top.alias("top"), F.count(F.lit(1)).alias("labels"), F.sum("k").alias("k"), F.sum("n").alias("n"), (F.sum("n") - F.max(F.struct("k", "label", "n"))["n"]).alias("rest_n"))
    per = scratch.materialize(per.where("labels > 1 AND k > 2"), "open")

    def blocks(n: str):
        return F.ceil(F.col(n) * 8 / held_bytes).cast("int")

    of = members.join(per.select("bucket", "top", F.greatest(blocks("n"), F.lit(1)).alias("wide"), F.greatest(blocks("rest_n"), F.lit(1)).alias("high")), "bucket")
    draw = F.xxhash64("node", F.lit("block"))

    def side(rest: bool) -> DataFrame:
        own, other = ("high", "wide") if rest else ("wide", "high")
        mine = F.pmod(draw, F.col(own)).cast("int").alias("i" if rest else "j")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("j" if rest else "i")
        rows = of.where("label <> top") if rest else of
        return rows.select("bucket", mine, every, F.lit(rest).alias("rest"), "node", "label").select("bucket", "i", "j", "rest", "node", "label")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []
        for batch in batches:
            for b, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (b, i, j) != key:
                    found += _compare(rows, similarity) if rows else ()
                    key, rows = (b, i, j), []
                rows.append(tuple(row))
        found += _compare(rows, similarity) if rows else ()
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    rows = side(True).unionByName(side(False)).join(sets, "node")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return scratch.map_arrow(rows.select("bucket", "i", "j", "rest", "node", "label", "shingles"), compare, "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bins: int = 256, band: int = 8, budget: int = 4) -> DataFrame:
    """row, doc_id, component_id and keeper of each row, for texts whose shingles are alike.

    Rows are linked if they are candidates (see the module) and the likeness of their
    sets of ``shingle`` lower-cased words is at least ``similarity``; component_id is
    the smallest doc_id of all that can be reached, null only if all of those are
    null. keeper: true for one row of each component, the first by doc_id (null last),
    then by place. Null or empty texts, and such without words, are equal to each other
    and unlike all else; a text of fewer words than a shingle is one shingle. Texts of
    any length are read whole. Repeated rows are rows of their own in one component.
    An empty table gives an empty result; other columns, whatever their names, are not
    read.
    """
    docs = scratch.placed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    seen = scratch.materialize(prints(docs, shingle, bins, band), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("first")
    twins = seen.groupBy("twin").agg(first, *[F.first(c).alias(c) for c in ("n", "fp", "bands")])
    nodes = scratch.materialize(twins.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # Buckets of two nodes or more, and the first node of each.
    members = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("held")).where("held > 1")
    buckets = scratch.materialize(buckets.select("bucket", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n")), "buckets")
    members = scratch.materialize(members.join(buckets, "bucket"), "members")
    alike = F.least("n", "lead_n") >= F.lit(similarity - 1e-9) * F.greatest("n", "lead_n")
    stars = members.where("node <> lead").where(alike).select(F.col("node").alias("u"), F.col("lead").alias("v"))

    # The trie's links, from the first node of each fingerprint to that of another.
    fps = scratch.materialize(nodes.groupBy("fp").agg(F.min("node").alias("lead")), "fps")
    trie = simhash.links(fps.select("fp"), budget)
    for end in ("u", "v"):
        trie = trie.join(fps.select(F.col("fp").alias(end), F.col("lead").alias(f"{end}_lead")), end)
    trie = trie.select(F.col("u_lead").alias("u"), F.col("v_lead").alias("v"))
    same = nodes.select("node", "fp").join(fps, "fp").where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v"))
    edges = stars.unionByName(trie).unionByName(same)
    edges = scratch.materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    wanted = members.select("node").unionByName(edges.select(F.col("u").alias("node"))).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    wanted = scratch.materialize(nodes.select(F.col("first.row").alias("row"), "node").join(wanted, "node", "left_semi"), "wanted")
    sets = scratch.materialize(_sets(docs, wanted.select("row", "node"), shingle), "sets")

    sure = scratch.materialize(verified(edges, sets, similarity), "sure")
    roots = scratch.materialize(simhash.components(sure), "roots")
    labelled = members.select("bucket", "node", "n").join(roots, "node", "left").select("bucket", "node", "n", F.coalesce("root", "node").alias("label"))
    more = scratch.materialize(open_links(scratch.materialize(labelled, "labelled"), sets, similarity), "more")
    # The second step joins whole groups, so only their roots are left to contract.
    for end in ("u", "v"):
        named = roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        more = more.join(named, end, "left").withColumn(end, F.coalesce(f"{end}_root", end)).drop(f"{end}_root")
    again = simhash.components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
    final = nodes.select("twin", "first", F.col("node").alias("own")).join(roots, F.col("own") == F.col("node"), "left")
    final = final.select("twin", "first", F.coalesce("root", "own").alias("root")).join(again, "root", "left").select("twin", "first", F.coalesce("top", "root").alias("root"))
    final = scratch.materialize(final, "final")
    best = scratch.materialize(final.groupBy("root").agg(F.min("first").alias("best")), "best")
    table = final.join(best, "root").select("twin", "best")
    return seen.select("row", "doc_id", "twin").join(table, "twin").select("row", "doc_id", F.col("best.id").alias("component_id"), (F.col("row") == F.col("best.row")).alias("keeper"))
