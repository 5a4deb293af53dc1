"""Reachability in a graph by rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.written import written


def reachable(seeds: DataFrame, edges: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """node and step of all nodes that edges (source, target) lead to from ``seeds`` (node), by the least number of steps.

    Each round follows the edges of the nodes that the round before found first, and keeps
    what no round has found; nodes met by many edges count once, by partial aggregates, before
    they are compared with what is known. Rounds are written tables, as many as the greatest step.
    Cycles end by themselves. Nulls lead nowhere. most_rounds: stop after so many.
    """
    edges = written(edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct(), "edges")
    found = [written(seeds.select("node").where("node IS NOT NULL").distinct().withColumn("step", F.lit(0)), "round")]
    while not found[-1].isEmpty() and (most_rounds is None or len(found) <= most_rounds):
        known = found[0]
        for f in found[1:]:
            known = known.unionByName(f)
        next_ = edges.join(found[-1].select(F.col("node").alias("source")), "source", "left_semi").select(F.col("target").alias("node")).distinct()
        found.append(written(next_.join(known.select("node"), "node", "left_anti").withColumn("step", F.lit(len(found))), "round"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def reachable_through(seeds: DataFrame, enters: DataFrame, leaves: DataFrame) -> DataFrame:
    """node and step of all nodes that gates lead to from ``seeds`` (node), by the least number of steps.

    enters (source, gate) and leaves (gate, target) stand for an edge from each source of a
    gate to each of its targets. Those pairs are never made: a round goes from the nodes that
    the round before found to their gates and on to the gates' targets, each counted once, so
    it takes no more than both tables, however many share a gate. As for ``reachable``, rounds
    are written, cycles end by themselves and nulls lead nowhere.
    """
    enters = written(enters.select("source", "gate").where("source IS NOT NULL AND gate IS NOT NULL").distinct(), "enters")
    leaves = written(leaves.select("gate", "target").where("gate IS NOT NULL AND target IS NOT NULL").distinct(), "leaves")
    found = [written(seeds.select("node").where("node IS NOT NULL").distinct().withColumn("step", F.lit(0)), "round")]
    while not found[-1].isEmpty():
        known = found[0]
        for f in found[1:]:
            known = known.unionByName(f)
        gates = enters.join(found[-1].select(F.col("node").alias("source")), "source", "left_semi").select("gate").distinct()
        next_ = leaves.join(gates, "gate", "left_semi").select(F.col("target").alias("node")).distinct()
        found.append(written(next_.join(known.select("node"), "node", "left_anti").withColumn("step", F.lit(len(found))), "round"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
