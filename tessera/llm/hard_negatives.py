"""Hard negatives by a dual-tree search over integer inner products.

Two trees hold the anchors and all rows. Their upper levels split space by a kd-tree
that is fitted on a bounded sample of rows; every row is placed in one of its cells.
Rows of a cell are dealt into blocks of bounded size, and a block is ordered into a
small tree of its own by label and place. A node has its mean, its radius and the
range of its labels, so that two nodes bound all inner products between their rows:

    c.c' - (r |c'| + r' |c| + r r')  <=  x.x'  <=  c.c' + (r |c'| + r' |c| + r r')

The search goes down both trees at once: first over pairs of cells, then over pairs
of blocks, then over nodes inside two blocks. A pair of nodes goes, for all anchors
below it, when its interval or its labels can't serve any of them; pairs of leaves
that are left are scored exactly. What an anchor still needs starts at what the
sampled rows give it, which are rows like any other, and rises as pairs are scored.

It runs twice: for each anchor's positives, then for the negatives in the windows that
the positives' scores open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch

#: Rows of a leaf inside a block.
_LEAF = 64
#: Pairs of leaves that are scored before what anchors need is brought up to date.
_STEP = 48
#: Blocks, of half a megabyte or so, in a batch for Python.
_ROWS = 8
#: Bytes of anchor blocks that may be broadcast; beyond, they are joined.
_BROADCAST = 32 << 20


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def eligible(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, label and vector (long components) of the rows that take part, each id once.

    Null ids, labels and vectors and those with a null or non-finite component don't. Of
    rows with one id the least by label, then by vector, counts.
    """
    x = F.col("raw")
    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("raw"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = plain.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~odd)
    return sound.select("id", F.struct("label", quantised(x, scale).alias("vector")).alias("row")).groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.vector")


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` doubles; shorter vectors are filled up by zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    n = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if len(n) and (n == dims).all():
        return flat.reshape(-1, dims).astype(np.float64)
    out = np.zeros((len(n), dims))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(np.arange(len(n)), n), at] = flat
    return out


@dataclass
class Cells:
    """A kd-tree by medians of a sample: node i has children 2i+1 and 2i+2, and splits at ``at[i]`` of dimension ``dim[i]``."""

    dim: np.ndarray
    at: np.ndarray
    depth: int

    @classmethod
    def fit(cls, sample: np.ndarray, depth: int) -> Cells:
        dim, at = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        parts = [np.arange(len(sample))]
        for i in range((1 << depth) - 1):
            own = parts[i]
            if len(own) and sample.shape[1]:
                dim[i] = int(sample[own].var(axis=0).argmax())
                at[i] = np.median(sample[own, dim[i]])
            low = sample[own, dim[i]] <= at[i] if sample.shape[1] else np.ones(len(own), bool)
            parts += [own[low], own[~low]]
        return cls(dim, at, depth)

    def place(self, x: np.ndarray) -> np.ndarray:
        """Each row's cell, neighbours in the tree having neighbouring numbers."""
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            right = x[np.arange(len(x)), self.dim[node]] > self.at[node] if x.shape[1] else np.zeros(len(x), bool)
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)


def _order(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """An order of rows in which neighbours are near: by label, then by halving the widest dimension."""
    out: list[np.ndarray] = []
    by = np.argsort(label, kind="stable")
    todo = [by[a:b] for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate(([0], np.flatnonzero(np.diff(label[by])) + 1, [len(by)]))), strict=True)][::-1]
    while todo:
        own = todo.pop()
        if len(own) <= _LEAF or not x.shape[1]:
            out.append(own)
            continue
        d = int(x[own].var(axis=0).argmax())
        half = len(own) // 2
        cut = own[np.argpartition(x[own, d], half)]
        todo += [cut[half:], cut[:half]]
    return np.concatenate(out) if out else by


class Tree:
    """Levels of nodes over rows in order, leaves first; a level has ``starts``, means, their lengths, radii and least and greatest labels."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        self.levels = []
        starts = np.arange(0, len(x), _LEAF)
        while True:
            n = np.diff(np.append(starts, len(x)))
            mean = np.add.reduceat(x, starts, axis=0) / n[:, None]
            away = np.sqrt(((x - np.repeat(mean, n, axis=0)) ** 2).sum(axis=1))
            self.levels.append((starts, mean, np.sqrt((mean**2).sum(axis=1)), np.maximum.reduceat(away, starts), np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)))
            if len(starts) == 1:
                break
            starts = starts[::2]


def _interval(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product between rows of nodes ``i`` and rows of nodes ``j``, wide enough for rounding."""
    mid = np.einsum("ij,ij->i", a[1][i], b[1][j])
    wide = a[3][i] * b[2][j] + b[3][j] * a[2][i] + a[3][i] * b[3][j]
    wide = wide * (1 + 1e-9) + np.abs(mid) * 1e-9 + 1e-3
    return mid - wide, mid + wide


class Search:
    """The best rows so far of a block of anchors, for ``w`` windows of scores each.

    low, high: bounds of each anchor's windows, both inside. same: whether rows need the
    anchor's label, or another one. need: the least score that may still enter, by window.
    """

    def __init__(self, ids: np.ndarray, label: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
        self.ids, self.label, self.x, self.high, self.same, self.k = ids, label, x, high, same, k
        self.need, self.tree = low.copy(), Tree(x, label)
        self.w = low.shape[1]
        self.found = np.zeros((0, 4), np.int64)  # anchor's place, window, row's id, score
        self.scored = 0

    def _merge(self, new: list[np.ndarray]) -> None:
        """Keep the first ``k`` of each window, by score, then id, and raise what it needs."""
        rows = np.concatenate([self.found, *new])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 3], rows[:, 1], rows[:, 0]))]
        key = rows[:, 0] * self.w + rows[:, 1]
        first = np.searchsorted(key, key)
        rank = np.arange(len(rows)) - first
        self.found = rows[rank < self.k]
        full = rows[rank == self.k - 1]
        self.need[full[:, 0], full[:, 1]] = np.maximum(self.need[full[:, 0], full[:, 1]], full[:, 3])

    def seed(self, ids: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        """Raise what windows need to the ``k``-th best of rows that will be met again."""
        score = self.x @ x.T
        fits = ((self.label[:, None] == label[None, :]) == self.same) & (self.ids[:, None] != ids[None, :])
        for j in range(self.w):
            inside = np.where(fits & (score <= self.high[:, j : j + 1]), score, -np.inf)
            if inside.shape[1] >= self.k:
                self.need[:, j] = np.maximum(self.need[:, j], np.partition(inside, inside.shape[1] - self.k, axis=1)[:, -self.k])

    def meet(self, ids: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        """Go down this tree and that of a block of rows together."""
        if not len(self.ids) or not len(ids):
            return
        mine, other = self.tree.levels, Tree(x, label).levels
        a, b = len(mine) - 1, len(other) - 1
        i = j = np.zeros(1, np.int64)
        while True:
            i, j, upper = self._alive(mine[a], i, other[b], j)
            if not len(i) or a == b == 0:
                break
            for mine_turn in (True, False):
                if (a if mine_turn else b) > 0:
                    level = mine[a - 1] if mine_turn else other[b - 1]
                    node = i if mine_turn else j
                    kids = np.stack((2 * node, 2 * node + 1), axis=1)
                    there = kids < len(level[0])
                    i, j = (kids[there], np.repeat(j, 2).reshape(-1, 2)[there]) if mine_turn else (np.repeat(i, 2).reshape(-1, 2)[there], kids[there])
                    a, b = (a - 1, b) if mine_turn else (a, b - 1)
        order = np.argsort(-upper, kind="stable")
        i, j = i[order], j[order]
        while len(i):
            self._score(mine[0], i[:_STEP], other[0], j[:_STEP], ids, label, x)
            # What these gave may rule out others.
            i, j, _ = self._alive(mine[0], i[_STEP:], other[0], j[_STEP:])

    def _alive(self, a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of nodes that may still serve an anchor, and the greatest product of each."""
        if not len(i):
            return i, j, np.zeros(0)
        least, most = _interval(a, i, b, j)
        need = np.minimum.reduceat(self.need.min(axis=1), a[0])
        high = np.maximum.reduceat(self.high.max(axis=1), a[0])
        ok = (most >= need[i]) & (least <= high[i])
        if self.same:
            ok &= (a[4][i] <= b[5][j]) & (b[4][j] <= a[5][i])
        else:
            ok &= ~((a[4][i] == a[5][i]) & (b[4][j] == b[5][j]) & (a[4][i] == b[4][j]))
        return i[ok], j[ok], most[ok]

    def _score(self, a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, ids: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        new = []
        for m in np.unique(i):
            s, e = a[0][m], min(a[0][m] + _LEAF, len(self.ids))
            at = np.concatenate([np.arange(b[0][n], min(b[0][n] + _LEAF, len(ids))) for n in j[i == m]])
            score = self.x[s:e] @ x[at].T
            self.scored += score.size
            fits = ((self.label[s:e, None] == label[at][None, :]) == self.same) & (self.ids[s:e, None] != ids[at][None, :])
            for w in range(self.w):
                p, q = np.nonzero(fits & (score >= self.need[s:e, w : w + 1]) & (score <= self.high[s:e, w : w + 1]))
                new.append(np.column_stack((p + s, np.full(len(p), w), ids[at[q]], score[p, q].astype(np.int64))))
        if any(map(len, new)):
            self._merge(new)


def _unpack(ids: list[int], labels: list[int], vectors: bytes, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.array(ids, np.int64), np.array(labels, np.int64), np.frombuffer(vectors, np.int32).reshape(len(ids), dims).astype(np.float64)


_BLOCK = {"cell": "int", "block": "long", "ids": "array<long>", "labels": "array<long>", "vectors": "binary", "mean": "array<double>", "radius": "double", "low": "long", "top": "long"}
_BALL = ("mean", "radius", "low", "top")


def _balls(group: tuple, own: pa.Table) -> pa.Table:
    """The ball around a cell's blocks."""
    means = np.array(own.column("mean").to_pylist(), float).reshape(own.num_rows, -1)
    mid = means.mean(axis=0)
    radius = float((np.sqrt(((means - mid) ** 2).sum(axis=1)) + own.column("radius").to_numpy()).max())
    return pa.table({"cell": pa.array([group[0].as_py()], pa.int32()), "mean": pa.array([mid.tolist()], pa.list_(pa.float64())), "radius": pa.array([radius], pa.float64())})


def _blocks(rows: DataFrame, counts: dict[int, int], size: int, dims: int) -> DataFrame:
    """Rows (id, label, vector, cell) as blocks of about ``size`` of one cell, each in the order of its tree, with its ball and labels.

    A cell's rows are dealt by id over as many blocks as its count asks for, so one that holds
    a third of all is many blocks.
    """
    n = F.create_map(*[F.lit(v) for c, held in counts.items() for v in (c, -(-held // size))]) if counts else F.lit(None).cast("map<int, int>")
    part = F.pmod(F.xxhash64("id"), F.coalesce(F.try_element_at(n, F.col("cell")), F.lit(1)))

    def gather(key: tuple, own: pa.Table) -> pa.Table:
        own = own.combine_chunks()
        ids, label = own.column("id").to_numpy(), own.column("label").to_numpy()
        by = np.argsort(ids)  # as rows may arrive in any order
        x = _matrix(own.column("vector").combine_chunks(), dims)[by]
        order = _order(x, label[by])
        ids, label, x = ids[by][order], label[by][order], x[order]
        mean = x.mean(axis=0)
        radius = float(np.sqrt(((x - mean) ** 2).sum(axis=1).max()))
        values = [key[0].as_py(), key[1].as_py(), ids.tolist(), label.tolist(), x.astype(np.int32).tobytes(), mean.tolist(), radius, int(label.min()), int(label.max())]
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.int64())
        return pa.table([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=list(_BLOCK))

    return rows.withColumn("block", part.cast("long")).groupBy("cell", "block").applyInArrow(gather, ", ".join(map(" ".join, _BLOCK.items())))


class Miner:
    """Anchors and rows in blocks of cells, for searches of anchors against all rows.

    rows: id, label and vector as ``eligible`` gives them. sample: at most so many rows,
    the least by a hash of their id, fit the cells and give anchors what they need at first;
    every row is indexed and met.
    """

    def __init__(self, rows: DataFrame, anchor: Column, sample: int = 4096, cells: int = 256, block: int = 2048):
        self.spark = rows.sparkSession
        self.rows = scratch.materialize(rows, "vectors")
        figures = self.rows.agg(F.max(F.size("vector")).alias("dims"), F.max(F.array_max(F.transform("vector", F.abs))).alias("most"), F.count(F.lit(1)).alias("n")).first()
        self.dims, most, n = int(figures["dims"] or 0), int(figures["most"] or 0), figures["n"]
        if most >= 1 << 31 or self.dims * most * most >= 1 << 53:
            raise ValueError("components are too large for exact scores")
        # The hash orders rows without regard to id or label.
        held = self.rows.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
        self.sample_ids, self.sample_label = (held.column(c).to_numpy() for c in ("id", "label"))
        self.sample = _matrix(held.column("vector").combine_chunks() if held.num_rows else pa.array([], pa.list_(pa.int64())), self.dims)
        depth = min(max(n // block, 1), cells, max(len(self.sample) // 16, 1)).bit_length() - 1
        tree, dims = Cells.fit(self.sample, depth), self.dims

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = tree.place(_matrix(batch.column(2), dims)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "label", "vector", "cell"])

        placed = scratch.materialize(scratch.map_arrow(self.rows.select("id", "label", "vector"), place, "id long, label long, vector array<long>, cell int"), "placed")
        self.blocks = scratch.materialize(_blocks(placed, self._counts(placed), block, dims), "blocks", _ROWS)
        chosen = self._together(placed.where(anchor), block)
        self.anchors = scratch.materialize(_blocks(chosen, self._counts(chosen), block, dims), "anchors", _ROWS)
        scratch.drop(self.rows, placed)

    @staticmethod
    def _counts(placed: DataFrame) -> dict[int, int]:
        """Rows by cell, of which there are at most ``cells``."""
        return {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}

    def _together(self, chosen: DataFrame, block: int) -> DataFrame:
        """Neighbouring cells of few anchors as one, so that blocks of anchors are few."""
        counts = self._counts(chosen)
        to, first, held = {}, None, 0
        for cell in sorted(counts):
            if first is None or held + counts[cell] > block:
                first, held = cell, 0
            to[cell], held = first, held + counts[cell]
        if not to:
            return chosen
        return chosen.withColumn("cell", F.element_at(F.create_map(*[F.lit(v).cast("int") for pair in to.items() for v in pair]), F.col("cell")))

    def _pairs(self, needs: DataFrame) -> DataFrame:
        """Pairs of anchor blocks and blocks of rows whose intervals may serve an anchor.

        Pairs of cells, at most ``cells`` squared, are looked at first; blocks meet by an equal
        join on the cells that are left.
        """

        def of(df: DataFrame, n: str, *cols: str) -> DataFrame:
            return df.select(*[F.col(c).alias(f"{n}_{c}") for c in cols])

        def cells(df: DataFrame, n: str) -> DataFrame:
            return of(df.select("cell", "mean", "radius").groupBy("cell").applyInArrow(_balls, "cell int, mean array<double>, radius double"), n, "cell", "mean", "radius")

        def bounds(df: DataFrame) -> tuple[Column, Column]:
            dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
            length = lambda n: F.sqrt(dot(f"{n}_mean", f"{n}_mean"))
            mid, r, t = dot("a_mean", "b_mean"), F.col("a_radius"), F.col("b_radius")
            wide = (r * length("b") + t * length("a") + r * t) * (1 + 1e-9) + F.abs(mid) * 1e-9 + 1e-3
            return mid - wide, mid + wide

        asked = needs.groupBy("a_cell").agg(F.min("need").alias("need"), F.max("high").alias("high"))
        ours = cells(self.anchors, "a").join(asked, "a_cell")
        met = ours.crossJoin(F.broadcast(cells(self.blocks, "b")))
        least, most = bounds(met)
        met = met.where((most >= F.col("need")) & (least <= F.col("high"))).select("a_cell", "b_cell")
        both = of(self.anchors, "a", "cell", "block", "mean", "radius").join(needs, ["a_cell", "a_block"]).join(F.broadcast(met), "a_cell").join(of(self.blocks, "b", "cell", "block", "mean", "radius"), "b_cell")
        least, most = bounds(both)
        return both.where((most >= F.col("need")) & (least <= F.col("high"))).select("a_cell", "a_block", "b_cell", "b_block")

    def search(self, same: bool, k: int, windows: DataFrame | None = None) -> DataFrame:
        """anchor, window, id, score and rank of the ``k`` best rows of each window of each anchor.

        windows: anchor, and for each window its lows and highs; without it one window takes
        all scores. Rows need the anchor's label if ``same``, else another one.
        """
        dims, sample = self.dims, (self.sample_ids, self.sample_label, self.sample)
        blocks = self.anchors.select(F.col("cell").alias("a_cell"), F.col("block").alias("a_block"), F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), F.col("vectors").alias("a_vectors"))
        if windows is None:
            asked = blocks.withColumns({"w_ids": F.lit(None).cast("array<long>"), **dict.fromkeys(("lows", "highs"), F.lit(None).cast("array<array<long>>"))})
        else:
            per = blocks.select("a_cell", "a_block", F.explode("a_ids").alias("anchor")).join(windows, "anchor").groupBy("a_cell", "a_block").agg(*[F.collect_list(c).alias(n) for c, n in (("anchor", "w_ids"), ("lows", "lows"), ("highs", "highs"))])
            asked = blocks.join(per, ["a_cell", "a_block"])

        def begin(row: dict) -> Search | None:
            ids, label, x = _unpack(row["a_ids"], row["a_labels"], row["a_vectors"], dims)
            if row["w_ids"] is None:
                low, high = np.full((len(ids), 1), -np.inf), np.full((len(ids), 1), np.inf)
            else:
                # Anchors without a window need nothing; windows that an anchor lacks take no score.
                w = max(map(len, row["lows"]))
                low, high = np.full((len(ids), w), np.inf), np.full((len(ids), w), -np.inf)
                at = {v: n for n, v in enumerate(ids.tolist())}
                for v, lo, hi in zip(row["w_ids"], row["lows"], row["highs"], strict=True):
                    low[at[v], : len(lo)], high[at[v], : len(hi)] = lo, hi
            out = Search(ids, label, x, low, high, same, k)
            out.seed(*sample)
            return out

        def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pylist()
                found = [begin(r) for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r["a_cell"] for r in rows], pa.int32()), pa.array([r["a_block"] for r in rows], pa.int64()), pa.array([float(s.need.min()) for s in found], pa.float64()), pa.array([float(s.high.max()) for s in found], pa.float64())], names=["a_cell", "a_block", "need", "high"])

        asked = scratch.materialize(asked, "asked", _ROWS)
        needs = scratch.materialize(scratch.map_arrow(asked, bounds, "a_cell int, a_block long, need double, high double"), "needs", _ROWS)
        pairs = scratch.materialize(self._pairs(needs), "pairs")
        names = asked.columns

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(held: Search | None) -> Iterator[pa.RecordBatch]:
                if held is not None and len(held.found):
                    f = held.found
                    yield pa.RecordBatch.from_arrays([pa.array(held.ids[f[:, 0]]), pa.array(f[:, 1].astype(np.int32)), pa.array(f[:, 2]), pa.array(f[:, 3])], names=["anchor", "window", "id", "score"])

            last, held = None, None
            for batch in batches:
                for n in range(batch.num_rows):
                    row = {c: batch.column(c)[n].as_py() for c in ("a_cell", "a_block")}
                    if (row["a_cell"], row["a_block"]) != last:
                        yield from out(held)
                        last = row["a_cell"], row["a_block"]
                        held = begin({c: batch.column(c)[n].as_py() for c in names})
                    held.meet(*_unpack(*(batch.column(c)[n].as_py() for c in ("b_ids", "b_labels", "b_vectors")), dims))
            yield from out(held)

        size = asked.agg(F.sum(F.octet_length("a_vectors") + 64 * F.size("a_ids"))).first()[0] or 0
        mine = F.broadcast(asked) if size <= _BROADCAST else asked
        others = self.blocks.select(F.col("cell").alias("b_cell"), F.col("block").alias("b_block"), F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("vectors").alias("b_vectors"))
        # Blocks of rows are dealt one by one; a task keeps what its anchors need from pair to pair.
        dealt = others.join(pairs.hint("shuffle_hash"), ["b_cell", "b_block"]).sortWithinPartitions("a_cell", "a_block").join(mine, ["a_cell", "a_block"])
        found = scratch.materialize(scratch.map_arrow(dealt.select(*names, "b_ids", "b_labels", "b_vectors"), score, "anchor long, window int, id long, score long"), "found", _ROWS)
        over = W.partitionBy("anchor", "window").orderBy(F.col("score").desc(), "id")
        best = found.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)
        scratch.drop(asked, needs, pairs)
        return best


def hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 5, least: int = 80, **options
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    A row's score is its inner product with the anchor, of components floor(scale * x). An
    anchor's positives are its first rows of the same label, by score, then id. Of each
    positive the first rows of another label with least * positive_score <= 100 *
    negative_score <= 100 * positive_score are returned. anchor: which rows are anchors, on
    the columns id and label.

    Rows that take part are those of ``eligible``; a shorter vector counts as filled up by
    zeros. An empty table, and anchors without positives or negatives, give no rows. Other
    columns aren't read. ValueError if scores could pass 2^53.
    """
    miner = Miner(eligible(rows, id_col, label_col, vector_col, scale), anchor, **options)
    found = scratch.materialize(miner.search(True, positives), "positives")
    ceil = lambda v: F.call_function("div", v + 99 - F.pmod(v + 99, F.lit(100)), F.lit(100).cast("long"))
    bounds = F.array_sort(F.collect_list(F.struct("rank", ceil(F.col("score") * least).alias("low"), F.col("score").alias("high"))))
    windows = found.groupBy("anchor").agg(bounds.alias("b")).select("anchor", F.col("b.low").alias("lows"), F.col("b.high").alias("highs"))
    mined = miner.search(False, negatives, windows)
    own = found.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return mined.join(own, ["anchor", "window"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
