"""Mixing sources to target weights by entropy balancing.

Of all document rates, the ones that meet the token constraints and stay closest
to 1 in relative entropy are exponentially tilted: rate = exp(sum of the
multipliers of the document's constraints). The multipliers minimise a convex
dual, found by Newton steps. A rate depends on a document's constraint cell alone, so
the corpus is summed to cells by one grouped aggregation, and each step's gradient
and Hessian are sums over those. Rates are rounded into whole copies so that each
cell's error is carried on to its smaller documents, and ends below one of the
smallest.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ranks, scratch, texts


def word_count(text: Column) -> Column:
    """Words of ``[^\\x20\\x09-\\x0D]+``; null has none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(texts.SEPARATORS.decode()))
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, texts.WORDS_SPLIT))).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], cap: float) -> list[float]:
    """Targets that share sum(sizes) by weight, none above cap times its size."""
    left, weight, out = float(sum(sizes)), float(sum(weights)), [0.0] * len(sizes)
    # Those that are full at the lowest level come first; the rest share what is left.
    for i in sorted(range(len(sizes)), key=lambda i: cap * sizes[i] / weights[i]):
        out[i] = min(weights[i] * left / weight, cap * sizes[i])
        left, weight = left - out[i], weight - weights[i]
    return out


def entropy_balance(
    cells: DataFrame, margins: list[str], targets: dict[str, dict[object, float]], mass: str, steps: int = 200, tolerance: float = 1e-10, held: int = 100_000
) -> dict[str, dict[object, float]]:
    """Multipliers for each margin's levels, so that sums of mass * rate meet ``targets``.

    cells: any table with the columns of ``margins`` (strings) and ``mass``. It is
    summed by margins once. Up to ``held`` such sums are stepped on as they are; more
    stay a table, and each step is a job over it. Levels without mass or target get no
    multiplier, which is a rate of 0. A level is one number on the driver, so margins
    are things like sources and languages. Raises if targets can't be met.
    """
    spark = cells.sparkSession
    cells = scratch.materialize(cells.groupBy(*margins).agg(F.sum(mass).cast("double").alias(mass)), "margins")
    few = cells.limit(held + 1).collect() if held else []
    few = few if len(few) <= held and held else None
    index = {(m, v): i for i, (m, v) in enumerate((m, v) for m in margins for v, t in targets[m].items() if t > 0)}
    goal = np.array([targets[m][v] for m, v in index])
    tilt, pairs = np.zeros(len(index)), [(a, b) for a in range(len(margins)) for b in range(len(margins))]

    def sums() -> list[tuple[int, int, float]]:
        """Tilted mass of each two levels that meet in a cell; of one level with itself, all of its mass."""
        if few is not None:
            out = []
            for row in few:
                at = [index.get((m, row[m])) for m in margins]
                if None not in at:
                    tilted = row[mass] * math.exp(sum(tilt[i] for i in at))
                    out += [(at[a], at[b], tilted) for a, b in pairs]
            return out
        tilted, log_rate = cells, F.lit(0.0)
        for j, m in enumerate(margins):
            table = spark.createDataFrame([(v, i, float(tilt[i])) for (name, v), i in index.items() if name == m], f"_v{j} string, _i{j} long, _t{j} double")
            tilted = tilted.join(table, F.col(m) == F.col(f"_v{j}"))
            log_rate = log_rate + F.col(f"_t{j}")
        each = F.explode(F.array(*[F.struct(F.col(f"_i{a}").alias("a"), F.col(f"_i{b}").alias("b")) for a, b in pairs])).alias("at")
        got = tilted.select(each, (F.col(mass) * F.exp(log_rate)).alias("_s")).groupBy("at").agg(F.sum("_s").alias("_s"))
        return [(r["at"]["a"], r["at"]["b"], r["_s"]) for r in got.collect()]

    off = 0.0
    for _ in range(steps if len(index) else 0):
        gradient, hessian = -goal.copy(), np.zeros((len(index), len(index)))
        for a, b, s in sums():
            hessian[a, b] += s
            gradient[a] += s * (a == b)
        off = np.abs(gradient / goal).max()
        if off < tolerance:
            break
        step = np.linalg.lstsq(hessian, -gradient, rcond=None)[0]
        tilt += np.clip(step, -1.0, 1.0)
    if off > 1e-6:
        raise RuntimeError(f"targets are off by a share of {off:.2g} after {steps} steps; they may contradict each other")
    out: dict[str, dict[object, float]] = {m: {} for m in margins}
    for (m, v), i in index.items():
        out[m][v] = float(tilt[i])
    return out


def _round_cell(cap: float):
    def rounded(rows: pd.DataFrame) -> pd.DataFrame:
        """Copies of each size class: long documents first, what is over or short goes on to the next."""
        rows = rows.sort_values("size", ascending=False)
        rate = min(max(float(rows["rate"].iloc[0]), 0.0), cap)
        low, high = math.floor(rate + 1e-9), math.ceil(rate - 1e-9)
        due, whole = 0.0, []
        for size, n in zip(rows["size"].tolist(), rows["n"].tolist(), strict=True):
            due += rate * n * size
            want = round(due / size) if size else round(rate * n)
            copies = min(max(want, low * n), high * n)
            due -= copies * size
            whole.append(copies - low * n)
        return pd.DataFrame({"key": rows["key"], "size": rows["size"], "low": low, "more": whole})

    return rounded


def mix(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", parts: int | None = None) -> DataFrame:
    """row, doc_id, size, source_size, target, copies and taken of each document.

    size: words of the text, null has 0. Sources, by code point and null last, get
    ``weights`` in turn; a target is at most cap times its source's size, and what
    is above goes to the others by weight. copies is an integer of at most
    ceil(cap); taken = copies * size. Which of the documents with one source and
    size get the extra copy is decided by a hash of doc_id and text, so reruns
    agree. Documents without words get copies by the same rate and take 0 words; in
    a source without any words they get none. Texts of any length count whole. Repeated
    rows are documents of their own; they tie, and which of them gets the extra copy is
    decided by their place in the file. Empty tables give none, and other columns aren't
    read. ``docs`` may be any DataFrame: rows that are not those of one Parquet table are
    written first.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text_col), F.lit(""))
    source = F.col(source_col).cast("string")
    named = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("key"), F.col(text_col).alias("text"), body.alias("body"))
    rows = scratch.spread(scratch.identified(named, "row"))
    slim = rows.select("row", "doc_id", "key", word_count(F.col("text")).alias("size"), F.xxhash64("body").alias("draw"), F.col("row.place").alias("place"))
    # By place as well, so that rows of one doc_id and text are many sub-groups' work.
    slim = scratch.materialize(slim.withColumn("sub", ranks.spread(parts, "doc_id", "draw", "place")), "sizes")

    subs = scratch.materialize(slim.groupBy("key", "size", "sub").agg(F.count(F.lit(1)).alias("n_sub")), "classes")
    cells = subs.groupBy("key", "size").agg(F.sum("n_sub").alias("n")).withColumn("mass", F.col("n") * F.col("size"))
    sizes = {r["key"]: r["mass"] for r in cells.groupBy("key").agg(F.sum("mass").alias("mass")).collect()}
    order = sorted(sizes, key=lambda k: (k == "n", k))
    goals = dict(zip(order, water_fill([sizes[k] for k in order], [weights[i % len(weights)] for i in range(len(order))], cap), strict=True))
    tilt = entropy_balance(cells, ["key"], {"key": goals}, "mass")["key"]
    # Rounded, so that the last bits of a sum, which depend on the order of its rows, decide nothing.
    plan = spark.createDataFrame([(k, sizes[k], goals[k], round(math.exp(tilt[k]), 9) if k in tilt else 0.0) for k in order], "key string, source_size long, target double, rate double")

    rounded = cells.join(plan.select("key", "rate"), "key").groupBy("key").applyInPandas(_round_cell(cap), "key string, size long, low long, more long")
    over = W.partitionBy("key", "size").orderBy("sub").rowsBetween(W.unboundedPreceding, 0)
    before = subs.select("key", "size", "sub", "n_sub", (F.sum("n_sub").over(over) - F.col("n_sub")).alias("off"))
    shares = before.join(rounded, ["key", "size"]).select("key", "size", "sub", "low", (F.col("more") - F.col("off")).alias("more")).join(plan.drop("rate"), "key")
    rn = F.row_number().over(W.partitionBy("key", "size", "sub").orderBy("draw", "doc_id", "place", "row"))
    copies = F.col("low") + F.when(F.col("rn") <= F.col("more"), 1).otherwise(0)
    out = slim.withColumn("rn", rn).join(shares, ["key", "size", "sub"])
    return out.select("row", "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
