"""Quality by hierarchical empirical Bayes.

A document's own evidence is a logistic classifier on figures of its form. Sites
add theirs: a host's share of good documents is drawn towards the global share,
and a path's towards its host's, by as many pseudo-documents as the variance
between hosts, or between the paths of a host, calls for (method of moments). A
sparse site thus says what its parent says. A document's posterior odds are its
likelihood ratio times the odds of its path, and its own share is left out of both
path and host, so that it isn't counted twice.

The labelled rows are scanned for training, then the corpus once for evidence; sites
are partial sums, of which only the variance figures, one row per level, reach the
driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch, texts

#: Bytes of text worked on at once; the arrays of figures() take about 60 times as much.
_BLOCK = 1 << 17
_SYMBOLS = b"#$%&*|@~^_<>{}[]\\/=+"


def _mark(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Byte classes whose shares are figures.
_CLASSES = {
    "symbols": _mark(_SYMBOLS),
    "upper": _mark(bytes(range(65, 91))),
    "digits": _mark(bytes(range(48, 58))),
    "bangs": _mark(b"!?"),
    "stops": _mark(b".,;:"),
    "lines": _mark(b"\n"),
    "wide": _mark(bytes(range(128, 256))),
}
FIGURES = ("words", *_CLASSES, "length", "distinct", "marked", "bare", "capitals", "repeats")


def figures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FIGURES for each text; shares are square roots, so that small ones count."""
    starts, ends, first = texts.words(data, offsets)
    n_docs, n = len(offsets) - 1, np.diff(first)
    out = np.zeros((n_docs, len(FIGURES)))
    if not len(starts):
        return out
    size = np.maximum(np.diff(offsets), 1)
    doc = np.repeat(np.arange(n_docs), n)
    some = np.maximum(n, 1)
    per_doc = {}
    inside = {}
    for name, table in _CLASSES.items():
        total = np.concatenate(([0], np.cumsum(table[data])))
        per_doc[name] = (total[offsets[1:]] - total[offsets[:-1]]) / size
        inside[name] = total[ends] - total[starts]
    length = ends - starts
    hashes = texts.word_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        tagged = texts.mix64(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        pair = texts.mix64(tagged[:-1] * np.uint64(3) + tagged[1:]) if len(tagged) > 1 else tagged[:0]
    pair_doc = doc[:-1][doc[:-1] == doc[1:]] if len(doc) > 1 else doc[:0]
    pair = pair[doc[:-1] == doc[1:]] if len(doc) > 1 else pair

    def distinct(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        _, where = np.unique(values, return_index=True)
        return np.bincount(of[where], minlength=n_docs)

    def share(words: np.ndarray) -> np.ndarray:
        return np.bincount(doc[words], minlength=n_docs) / some

    n_pairs = np.bincount(pair_doc, minlength=n_docs)
    columns = {
        "words": np.log1p(n) / 10,
        **{k: np.sqrt(v) for k, v in per_doc.items()},
        "length": np.minimum(np.bincount(doc, length, n_docs) / some, 40) / 10,
        "distinct": distinct(tagged, doc) / some,
        "marked": np.sqrt(share((inside["symbols"] > 0) & (inside["symbols"] < length))),
        "bare": np.sqrt(share(inside["symbols"] == length)),
        "capitals": np.sqrt(share((inside["upper"] > 1) & (2 * inside["upper"] > length))),
        "repeats": np.sqrt(1 - distinct(pair, pair_doc) / np.maximum(n_pairs, 1)) * (n_pairs > 0),
    }
    for i, name in enumerate(FIGURES):
        out[:, i] = columns[name]
    out[n == 0] = 0
    return out


@dataclass(frozen=True)
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    #: Share of good documents that the classifier was fitted at.
    share: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0], -20, 20)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Classifier:
    """Logistic regression by Newton steps. Without both classes every document is like the prior."""
    share = float(y.mean()) if len(y) else 0.5
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(y) else (np.zeros(len(FIGURES)), np.ones(len(FIGURES)))
    share = min(max(share, 1e-3), 1 - 1e-3)
    w = np.zeros(len(FIGURES) + 1)
    w[0] = math.log(share / (1 - share))
    if 0 < y.sum() < len(y):
        design = np.column_stack([np.ones(len(x)), (x - mean) / scale])
        penalty = np.diag([0.0] + [ridge] * len(FIGURES))
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + penalty + 1e-9 * np.eye(len(w)), design.T @ (p - y) + penalty @ w)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
    return Classifier(mean, scale, w, share)


def train(docs: DataFrame, labels: DataFrame, label_col: str, sample: int) -> Classifier:
    """Fit on at most ``sample`` labelled doc_ids, those with the smallest hashes, and one row of each.

    sample bounds what is broadcast (ids) and what reaches the driver (a row of figures
    for each id). Of several rows with one doc_id the one with the least figures counts.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id IS NOT NULL AND y IN (0, 1)")
    chosen = known.groupBy("_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.where("text IS NOT NULL").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("_id", "y", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in texts.blocks(batch.column(2), _BLOCK):
                own = (batch.column(i).slice(lo, hi - lo) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c) for c in figures(data, offsets).T)], ["_id", "y", *FIGURES])

    kind = rows.schema["_id"].dataType.simpleString()
    seen = scratch.map_arrow(rows, read, f"_id {kind}, y int, " + ", ".join(f"{c} double" for c in FIGURES))
    got = seen.groupBy("_id").agg(F.min(F.struct("y", *FIGURES)).alias("one")).select("one.*").toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, len(FIGURES))), np.zeros(0))
    order = np.lexsort([c.to_numpy() for c in got.columns])  # sums don't depend on the order of arrival
    return fit(np.column_stack([got.column(i + 1).to_numpy() for i in range(len(FIGURES))])[order], got.column(0).to_numpy().astype(float)[order])


def _strength(groups: DataFrame, parent: str, within: float) -> float:
    """Pseudo-documents of the parent's share, from the variance of the groups' shares around it.

    groups: n, good and the share ``parent`` that each is drawn towards.
    """
    r = F.col("good") / F.col("n")
    a = groups.agg(F.sum(F.col("n") * F.pow(r - F.col(parent), 2)).alias("spread"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.avg(parent).alias("share")).first()
    if not a["n"] or a["k"] < 2:
        return 1e6
    size = a["n"] - a["nn"] / a["n"]
    between = max((a["spread"] - (a["k"] - 1) * within) / size, 0.0) if size > 0 else 0.0
    share = min(max(a["share"], 1e-3), 1 - 1e-3)
    return min(max(share * (1 - share) / max(between, 1e-9) - 1, 1.0), 1e6)


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | str = "source", path: Column | str = "lang", label_col: str = "quality", sample: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """row, doc_id, evidence, host_share, path_share, posterior and kept of each row.

    host, path: the site of a row; null is a site of its own. evidence: the
    classifier's log odds without the prior. kept: posterior of at least
    ``threshold``. A null text or one without words is judged by figures that are
    all 0. Labels that are null count for nothing, and of several for one doc_id the
    lowest counts; without labels of both classes documents have no evidence.
    host_share and path_share are those of the site without the row itself. Texts of any
    length are read whole. Equal texts at one site tie in all figures; repeated rows are
    rows of their own. An empty table gives an empty result; other columns, whatever
    their names, are not read. ``docs`` may be any DataFrame: rows that are not those of
    one Parquet table are written first.
    """
    host, path = (F.col(c) if isinstance(c, str) else c for c in (host, path))

    def named(site: Column) -> Column:
        return F.coalesce(F.concat(F.lit("s"), site.cast("string")), F.lit("n"))

    slim = docs.select(F.col(id_col).alias("doc_id"), named(host).alias("host"), named(path).alias("path"), F.col(text_col).alias("text"))
    rows = scratch.identified(slim, "row").select("row", "doc_id", "host", "path", "text")
    model = train(rows.select("doc_id", "text"), labels, label_col, sample)
    prior = math.log(model.share / (1 - model.share))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.logit(figures(data, offsets)) for _, _, data, offsets in texts.blocks(batch.column(4), _BLOCK)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.concatenate(got) if got else np.zeros(0))], ["row", "doc_id", "host", "path", "logit"])

    kind = docs.schema[id_col].dataType.simpleString()
    seen = scratch.map_arrow(scratch.spread(rows), read, f"row struct<file: long, place: long>, doc_id {kind}, host string, path string, logit double")
    seen = scratch.materialize(seen.withColumn("p", 1 / (1 + F.exp(-F.col("logit")))), "evidence")

    paths = scratch.materialize(seen.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good"), F.sum(F.col("p") * F.col("p")).alias("squares")), "paths")
    whole = paths.agg(F.sum("n"), F.sum("good"), F.sum("squares")).first()
    total = whole[0] or 1
    share = (whole[1] or 0.0) / total if whole[0] else 0.5
    within = max((whole[2] or 0.0) / total - share * share, 1e-6)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("parent", F.lit(share))
    hosts_by = _strength(hosts, "parent", within)
    host_share = hosts.select("host", ((F.lit(hosts_by * share) + F.col("good")) / (hosts_by + F.col("n"))).alias("host_share"))
    sites = paths.join(host_share, "host")
    paths_by = _strength(sites, "host_share", within)
    whole = hosts.select("host", F.col("n").alias("_hn"), F.col("good").alias("_hgood"))
    sites = sites.select("host", "path", F.col("n").alias("_n"), F.col("good").alias("_good")).join(whole, "host")

    # The row's own share is left out of its path and of its host.
    rest = (F.lit(hosts_by * share) + F.col("_hgood") - F.col("p")) / (hosts_by + F.col("_hn") - 1)
    path_share = (rest * paths_by + F.col("_good") - F.col("p")) / (paths_by + F.col("_n") - 1)
    evidence = F.col("logit") - prior
    out = seen.join(sites, ["host", "path"]).withColumn("host_share", rest).withColumn("path_share", path_share)
    out = out.select("row", "doc_id", evidence.alias("evidence"), "host_share", "path_share", (1 / (1 + F.exp(-(evidence + _logit(F.col("path_share")))))).alias("posterior"))
    return out.withColumn("kept", F.col("posterior") >= threshold)
