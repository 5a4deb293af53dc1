"""Toxicity by class-conditional Kneser-Ney models.

An expression is a word, read symbol by symbol between marks for its start and
end, so that compounds and inflections of a toxic stem are known by their first
symbols. Each class, toxic and ordinary, has its own highest order: how often a
symbol follows the (up to) ``order - 1`` symbols before it in the class's training
texts. Below it both classes share the Kneser-Ney orders, made of continuation
counts: in how many different contexts a sequence was seen. All orders are
discounted and interpolated, so a rare expression falls back to what the classes
share and says little about either.

Counts cover every labelled training text and are exact sums over keys that hold
up to eight symbols. Each key has its own figures, so what is gathered grows with the
number of different sequences. Up to a counted number of them they are broadcast;
beyond it they stay tables, and the corpus's different words are spelt out and joined
with them.

A text's words are compared by log P(toxic) - log P(ordinary). Three figures place
the text on a logistic curve: the mean over all words, which is the length-normalised
ratio of the two likelihoods; the excess of toxic words over the square root of the
length; and the most toxic word, a maximum, which is not normalised. The curve is
fitted on a fold that the counts leave out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, texts

_START, _END, _NUL = 1, 2, 3
_SYMBOL = np.arange(256, dtype=np.uint8)
_SYMBOL[65:91] += 32
_SYMBOL[0] = _NUL
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()[]{}-_*#&%$|<>/\\")] = True
_BLOCK = 1 << 22
_COUNTS = "key long, ordinary long, toxic long"


@dataclass(frozen=True)
class Settings:
    #: Symbols of the highest order, 2 to 8.
    order: int = 5
    #: Places of each table's index, as a power of two; of no effect on the figures.
    bits: int = 20
    #: Labels are broadcast up to so many rows, about 20 bytes each; more are joined by a shuffle.
    broadcast: int = 1_000_000
    #: Sequences are broadcast up to so many, about 40 bytes each; more are joined by a shuffle.
    sequences: int = 4_000_000
    #: Cells of figures that the curve is fitted on at most; the grid is widened until it has no more.
    cells: int = 100_000
    #: Absolute discount of each order.
    discount: float = 0.75
    #: A word counts as an excess by what its log ratio is over this.
    margin: float = 2.0


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5; null as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased symbols; starts and ends of words without punctuation at their ends; each text's first word."""
    low = _SYMBOL[data]
    starts, ends, first = texts.words(data, offsets)
    if len(starts):
        # The nearest symbols that are no punctuation, back from each end and on from each start.
        place = np.arange(len(low))
        back = np.maximum.accumulate(np.where(_EDGE[low], -1, place))
        on = np.minimum.accumulate(np.where(_EDGE[low], len(low), place)[::-1])[::-1]
        ends = np.maximum(back[ends - 1] + 1, starts + 1)
        starts = np.where(on[starts] < ends, on[starts], starts)
    return low, starts, ends, first


def _spelt(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words' symbols between marks, each symbol's place in its word, and its word."""
    size = ends - starts + 2
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(int(size.sum())) - first[word]
    source = np.clip(starts[word] + place - 1, 0, max(len(low) - 1, 0))
    symbol = low[source].astype(np.int64)
    symbol[first] = _START
    symbol[first + size - 1] = _END
    return symbol, place, word


def _key(symbol: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` symbols up to each, fewer at a word's start, the newest in the low byte."""
    key = symbol.copy()
    for back in range(1, order):
        key[back:] |= np.where(place[back:] >= back, symbol[:-back] << (8 * back), 0)
    return key


class _Table:
    """Figures (one array row each) by exact key; 0 for a key that isn't held. Keys are sorted, and found from an index of their first bits."""

    def __init__(self, key: np.ndarray, figures: np.ndarray, bits: int):
        mixed = self._mixed(key)
        order = np.argsort(mixed)
        self.bits, self.keys = bits, mixed[order]
        # A last column of zeros stands for keys that aren't held.
        self.figures = np.concatenate((figures[:, order], np.zeros((len(figures), 1))), axis=1)
        self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        self.most = int(np.diff(self.first, append=len(key)).max())

    @staticmethod
    def _mixed(key: np.ndarray) -> np.ndarray:
        """A bijection, so equal only for equal keys."""
        return texts.mix64(key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def at(self, key: np.ndarray) -> np.ndarray:
        """Each key's column of ``figures``."""
        mixed, n = self._mixed(key), len(self.keys)
        if not n:
            return np.zeros(len(key), np.int64)
        place = self.first[(mixed >> np.uint64(64 - self.bits)).astype(np.int64)]
        # Steps by halves through the keys that share an index place.
        step = 1 << max(self.most, 1).bit_length()
        while step := step >> 1:
            ahead = place + step
            place = np.where((ahead <= n) & (self.keys[np.minimum(ahead, n) - 1] < mixed), ahead, place)
        return np.where(self.keys[np.minimum(place, n - 1)] == mixed, np.minimum(place, n - 1), n)


def _count(train: DataFrame, order: int) -> DataFrame:
    """key, ordinary and toxic: occurrences of each highest-order sequence in both classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, data, offsets in texts.blocks(batch.column(0), _BLOCK):
                low, starts, ends, first = _words(data, offsets)
                if not len(starts):
                    continue
                of = np.repeat(toxic[lo:hi], np.diff(first))
                _, where, index = np.unique(texts.word_hashes(low, starts, ends), return_index=True, return_inverse=True)
                n = np.stack([np.bincount(index, minlength=len(where)), np.bincount(index, of, len(where)).astype(np.int64)])
                symbol, place, word = _spelt(low, starts[where], ends[where])
                inner = place > 0
                key, at = np.unique(_key(symbol, place, order)[inner], return_inverse=True)
                every, bad = (np.bincount(at, n[i][word[inner]], len(key)).astype(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(every - bad), pa.array(bad)], ["key", "ordinary", "toxic"])

    rows = scratch.map_arrow(train.select("text", "toxic"), count, _COUNTS)
    return rows.groupBy("key").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _length(key: Column, order: int) -> Column:
    out = F.lit(1)
    for n in range(1, order):
        out = F.when(F.shiftrightunsigned(key, 8 * n) != 0, n + 1).otherwise(out)
    return out


def _sums(rows: DataFrame, table: int, key: Column, *figures: Column) -> DataFrame:
    """table, key and the sums f0 to f3 of ``figures`` by key."""
    sums = [F.sum(c.cast("double")) for c in figures] + [F.lit(0.0)] * (4 - len(figures))
    return rows.groupBy(key.alias("key")).agg(*[c.alias(f"f{i}") for i, c in enumerate(sums)]).select(F.lit(table).alias("table"), "key", "f0", "f1", "f2", "f3")


class Model:
    """The counts of both classes and of the orders they share, by exact key."""

    def __init__(self, own: _Table, context: _Table, shared: _Table, below: _Table, s: Settings):
        self.own, self.context, self.shared, self.below, self.s = own, context, shared, below, s

    def _order(self, lower: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        d = self.s.discount
        seen = np.maximum(total, 1)
        return np.where(total > 0, np.minimum(np.maximum(n - d, 0) / seen, 1) + np.minimum(d * kinds / seen, 1) * lower, lower)

    def ratios(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log P(toxic) - log P(ordinary) of each word."""
        s = self.s
        symbol, place, word = _spelt(low, starts, ends)
        p = np.full(len(symbol), 1 / 256)
        key = np.zeros(len(symbol), np.int64)
        for m in range(1, s.order):
            at = np.flatnonzero(place >= m)
            key[at] |= symbol[at - (m - 1)] << (8 * (m - 1))
            gram, under = self.shared.at(key[at]), self.below.at(key[at] >> 8)
            p[at] = self._order(p[at], self.shared.figures[0, gram], self.below.figures[0, under], self.below.figures[1, under])
        inner = np.flatnonzero(place > 0)
        top = _key(symbol, place, s.order)[inner]
        gram, under = self.own.at(top), self.context.at(top >> 8)
        own, context = self.own.figures, self.context.figures
        logs = [np.log(self._order(p[inner], own[c, gram], context[c, under], context[2 + c, under])) for c in (0, 1)]
        return np.bincount(word[inner], logs[1] - logs[0], len(starts))

    def figures(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """mean, excess and most of each text; zeros without words."""
        low, starts, ends, first = _words(data, offsets)
        out = np.zeros((3, len(offsets) - 1))
        if not len(starts):
            return out
        _, where, index = np.unique(texts.word_hashes(low, starts, ends), return_index=True, return_inverse=True)
        each = self.ratios(low, starts[where], ends[where])[index]
        n = np.diff(first)
        full = np.flatnonzero(n)
        at = first[:-1][full]
        out[0, full] = np.add.reduceat(each, at) / n[full]
        out[1, full] = np.add.reduceat(np.maximum(each - self.s.margin, 0), at) / np.sqrt(n[full])
        out[2, full] = np.maximum(np.maximum.reduceat(each, at), 0)
        return out


#: Numbers of the tables of figures: of each class, sequences and what goes before them; of both, the same.
_OWN, _CONTEXT, _SHARED, _BELOW = range(4)


def figures_of(train: DataFrame, s: Settings) -> DataFrame:
    """table, key and f0 to f3 of all sequences of ``train`` (text and toxic, 0 or 1), written."""
    if not 2 <= s.order <= 8:
        raise ValueError("order must be from 2 to 8")
    top = scratch.materialize(_count(train, s.order).withColumn("size", _length(F.col("key"), s.order)), "sequences")
    under, classes = F.shiftrightunsigned("key", 8), (F.col("ordinary"), F.col("toxic"))

    # Each lower order counts the different sequences, one symbol longer, that end in each of its own.
    levels, longer = [], None
    for m in range(s.order - 1, 0, -1):
        rows = top.where(F.col("size") == m + 1).where(F.lit(m + 1 == s.order) | (F.shiftrightunsigned("key", 8 * m) == _START)).select("key")
        if longer is not None:
            rows = rows.unionByName(longer.select("key"))
        cut = F.col("key").bitwiseAND(F.lit((1 << 8 * m) - 1).cast("long"))
        longer = scratch.materialize(rows.select(cut.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "order")
        levels.append(longer)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    out = _sums(top, _OWN, F.col("key"), *classes)
    out = out.unionByName(_sums(top, _CONTEXT, under, *classes, *[F.when(c > 0, 1).otherwise(0) for c in classes]))
    out = out.unionByName(_sums(every, _SHARED, F.col("key"), F.col("n"))).unionByName(_sums(every, _BELOW, under, F.col("n"), F.lit(1)))
    out = scratch.materialize(out, "model")
    scratch.drop(top, *levels)
    return out


def gathered(table: DataFrame, s: Settings) -> Model:
    """The model of ``figures_of`` on the driver."""
    got = table.toArrow()
    kind, key = got.column(0).to_numpy(), got.column(1).to_numpy()
    figures = np.stack([got.column(i).to_numpy() for i in range(2, 6)])
    return Model(*[_Table(key[kind == k], figures[:n, kind == k], s.bits) for k, n in ((_OWN, 2), (_CONTEXT, 4), (_SHARED, 1), (_BELOW, 2))], s)


def fit(train: DataFrame, s: Settings) -> Model:
    """train: text and toxic (0 or 1) of all rows to count."""
    table = figures_of(train, s)
    model = gathered(table, s)
    scratch.drop(table)
    return model


_FIGURES = "mean double, excess double, most double"


def compare(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, and mean, excess and most of its text, written."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            got = [m.figures(data, offsets) for _, _, data, offsets in texts.blocks(batch.column(1), _BLOCK)]
            figures = np.concatenate(got, axis=1) if got else np.zeros((3, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f) for f in figures)], ["doc_id", "mean", "excess", "most"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = scratch.materialize(scratch.map_arrow(docs.select("doc_id", "text"), read, f"doc_id {kind}, {_FIGURES}"), "figures")
    sent.destroy()
    return out


def _spellings(rows: DataFrame) -> DataFrame:
    """row, word (its symbols) and n of each row's different words."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in texts.blocks(batch.column(1), _BLOCK):
                low, starts, ends, first = _words(data, offsets)
                if not len(starts):
                    continue
                doc = np.repeat(np.arange(hi - lo), np.diff(first))
                tagged = texts.mix64(texts.word_hashes(low, starts, ends) + texts.mix64(doc.astype(np.uint64) + np.uint64(1)))
                _, where, n = np.unique(tagged, return_index=True, return_counts=True)
                raw = low.tobytes()
                spelt = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + doc[where])), pa.array(spelt, pa.binary()), pa.array(n)], ["row", "word", "n"])

    return scratch.map_arrow(rows.select("row", "text"), read, "row struct<file: long, place: long>, word binary, n long")


def _grams(words: DataFrame, order: int) -> DataFrame:
    """word, place, m and key: of each symbol of a word, the sequences of m symbols up to it; m is ``order`` for the highest, whatever its length."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, low, offsets in texts.blocks(batch.column(1), 1 << 18):
                symbol, place, word = _spelt(low, offsets[:-1], offsets[1:])
                for m in range(1, order + 1):
                    at = np.flatnonzero(place >= (m if m < order else 1))
                    key = _key(symbol, place, m)[at]
                    ids = batch.column(0).take(pa.array(lo + word[at]))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(place[at].astype(np.int32)), pa.array(np.full(len(at), m, np.int32)), pa.array(key)], ["word", "place", "m", "key"])

    return scratch.map_arrow(words, read, "word long, place int, m int, key long")


def compare_by_join(docs: DataFrame, table: DataFrame, s: Settings) -> DataFrame:
    """What ``compare`` gives, by joins with the table of ``figures_of``: for models that are too large to broadcast."""
    rows = scratch.identified(docs.select("doc_id", "text"), "row")
    spelt = scratch.materialize(_spellings(scratch.spread(rows)), "spellings")
    words = scratch.materialize(spelt.select("word").distinct().select(F.monotonically_increasing_id().alias("id"), "word"), "words")
    grams = _grams(words, s.order).withColumn("own", F.col("m") == s.order).withColumn("under", F.shiftrightunsigned("key", 8))
    for name, own, shared in (("key", _OWN, _SHARED), ("under", _CONTEXT, _BELOW)):
        side = table.where(F.col("table").isin(own, shared)).select((F.col("table") == own).alias("own"), F.col("key").alias(name), F.struct("f0", "f1", "f2", "f3").alias(f"of_{name}"))
        grams = grams.join(side, ["own", name], "left")
    n, of = F.col("of_key"), F.col("of_under")
    d, zero = F.lit(s.discount), F.lit(0.0)

    def step(count: Column, total: Column, kinds: Column) -> tuple[Column, Column]:
        """An order's probability as a + b times the order's below it."""
        seen = F.greatest(total, F.lit(1.0))
        a = F.least(F.greatest(count - d, zero) / seen, F.lit(1.0))
        return F.when(total > 0, a).otherwise(zero), F.when(total > 0, F.least(d * kinds / seen, F.lit(1.0))).otherwise(F.lit(1.0))

    def figure(side: Column, i: int) -> Column:
        return F.coalesce(side[f"f{i}"], zero)

    # One row for each order of a symbol, so that plain maxima bring them together without lists.
    lower = step(figure(n, 0), figure(of, 0), figure(of, 1))
    steps = {f"low{m}": (F.col("m") == m, lower) for m in range(1, s.order)}
    steps |= {f"own{c}": (F.col("own"), step(figure(n, c), figure(of, c), figure(of, 2 + c))) for c in (0, 1)}
    per = grams.groupBy("word", "place").agg(*[F.max(F.when(where, x)).alias(f"{name}{part}") for name, (where, ab) in steps.items() for part, x in zip("ab", ab, strict=True)])
    below = F.lit(1 / 256)
    for m in range(1, s.order):
        # An order that reaches before a word's start says what the one below it says.
        below = F.coalesce(f"low{m}a", zero) + F.coalesce(f"low{m}b", F.lit(1.0)) * below
    logs = [F.log(F.col(f"own{c}a") + F.col(f"own{c}b") * F.col("below")) for c in (0, 1)]
    ratio = per.withColumn("below", below).groupBy("word").agg(F.sum(logs[1] - logs[0]).alias("ratio"))
    ratio = scratch.materialize(words.join(ratio.withColumnRenamed("word", "id"), "id").select("word", "ratio"), "ratios")

    each = spelt.join(ratio, "word").groupBy("row").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("ratio")).alias("sum"), F.sum(F.col("n") * F.greatest(F.col("ratio") - s.margin, zero)).alias("over"), F.max("ratio").alias("max")
    )
    got = rows.select("row", "doc_id").join(each, "row", "left")
    mean, excess, most = F.col("sum") / F.col("n"), F.col("over") / F.sqrt("n"), F.greatest(F.col("max"), zero)
    out = scratch.materialize(got.select("doc_id", *[F.coalesce(c, zero).alias(name) for c, name in ((mean, "mean"), (excess, "excess"), (most, "most"))]), "figures")
    scratch.drop(spelt, words, ratio)
    return out


def logistic(x: np.ndarray, n: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Offset and slopes of the curve through ``y`` of ``n`` at each row of x, by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (n * p - y) + ridge * w
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return w


#: The curve is fitted on counts over a grid of these steps.
GRID = {"mean": 0.02, "excess": 0.05, "most": 0.25}


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``.

    Rows whose fold is 0 are held out and their labels are never read. Folds 1 to 3
    are counted and fold 4 places the logistic curve. A score depends on the text
    alone. Null or empty texts score what three zeros score; without labels of both
    classes every score is 0.5. Labels that are null, or whose doc_id is null, count
    for nothing; a doc_id with several labels counts as toxic if one says so; rows of
    ``docs`` may repeat, and equal texts tie in their score. Texts of any length are
    read whole. An empty table gives an empty result; other columns, whatever their
    names, are not read.
    """
    s = settings or Settings()
    rows = scratch.spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("toxic")).where("_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(fold(F.col("_id")) != 0).groupBy("_id").agg(F.max("toxic").alias("toxic"))
    known = scratch.materialize(known, "labels")
    known = F.broadcast(known) if known.count() <= s.broadcast else known.hint("shuffle_hash")
    train = rows.where(fold(F.col("doc_id")).isin(1, 2, 3)).join(known, F.col("doc_id") == F.col("_id")).select("text", "toxic")
    table = figures_of(train, s)
    compared = compare(rows, gathered(table, s)) if table.count() <= s.sequences else compare_by_join(rows, table, s)
    scratch.drop(table)
    wide = np.array(list(GRID.values()))
    cells = compared.where(fold(F.col("doc_id")) == 4).join(known, F.col("doc_id") == F.col("_id")).select(*GRID, F.lit(1).alias("n"), F.col("toxic").alias("y"))
    while True:
        steps = [F.round(F.col(c) / float(step)).alias(c) for c, step in zip(GRID, wide, strict=True)]
        grid = scratch.materialize(cells.groupBy(*steps).agg(F.sum("n").alias("n"), F.sum("y").alias("y")), "grid")
        if grid.count() <= s.cells:
            break
        wide = 2 * wide
    placed = grid.toArrow()
    *x, n, y = (c.to_numpy().astype(float) for c in placed.columns)
    order = np.lexsort(x)  # sums don't depend on the order of arrival
    w = logistic(np.column_stack(x)[order] * wide, n[order], y[order]) if 0 < y.sum() < n.sum() else np.zeros(4)
    z = F.lit(float(w[0]))
    for c, slope in zip(GRID, w[1:], strict=True):
        z = z + F.lit(float(slope)) * F.col(c)
    return compared.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
