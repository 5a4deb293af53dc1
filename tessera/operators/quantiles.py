"""Exact quantiles of groups of any size, by counted ranges instead of a buffer per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.written import written


def exact_quantiles(rows: DataFrame, by: Sequence[str], value: Column, fractions: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """``by``, fraction and quantile: the value at rank fraction * (n - 1) of each group, between ranks by proportion.

    A mergeable sketch brackets each rank: it errs by at most n / ``accuracy``. The rows
    below a bracket are counted, and those inside are counted by value, both by partial
    aggregates, so a group that holds all rows is every task's work; what one task
    sorts at the end are the different values of a bracket, about 6 n / ``accuracy``. A
    bracket that its counts prove wrong is an error, not a wrong answer. Nulls don't count
    as values, and a group without any has none; null keys are a group.
    """
    by, n = list(by), len(fractions)
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)]
    group = [f"k{i}" for i in range(len(by))]
    v = rows.select(*keys, value.cast("double").alias("v")).where("v IS NOT NULL")
    slack = 3 / accuracy
    ends = [max(f - slack, 0.0) for f in fractions] + [min(f + slack, 1.0) for f in fractions]
    sketch = v.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", ends, accuracy).alias("ends"), F.min("v").alias("least"), F.max("v").alias("most"))
    # Brackets of the first and last ranks reach the ends, and those of groups so small that one rank is more than the sketch's error are all of the group.
    small = F.col("n") * slack < 4
    low = [F.when(small | F.lit(ends[i] <= 0), F.col("least")).otherwise(F.col("ends")[i]) for i in range(n)]
    high = [F.when(small | F.lit(ends[n + i] >= 1), F.col("most")).otherwise(F.col("ends")[n + i]) for i in range(n)]
    brackets = [F.struct(F.lit(i).alias("i"), low[i].alias("lo"), high[i].alias("hi")) for i in range(n)]
    held = written(sketch.select(*group, "n", F.array(*brackets).alias("b")), "brackets")
    if group:
        names = {g: f"{g}_" for g in group}
        match = F.lit(True)
        for g in group:
            match = match & F.col(g).eqNullSafe(F.col(names[g]))
        met = v.join(held.withColumnsRenamed(names), match).drop(*names.values())
    else:
        met = v.crossJoin(F.broadcast(held))
    below = met.groupBy(*group).agg(*[F.count_if(F.col("v") < F.col("b")[i]["lo"]).alias(f"below{i}") for i in range(n)])
    inside = met.select(*group, "n", "v", F.inline(F.filter("b", lambda b: (F.col("v") >= b["lo"]) & (F.col("v") <= b["hi"])))).groupBy(*group, "n", "i", "v").agg(F.count(F.lit(1)).alias("c"))
    stacked = below.select(*group, F.posexplode(F.array(*[f"below{i}" for i in range(n)])).alias("i", "below"))
    ranks = F.element_at(F.array(*map(F.lit, map(float, fractions))), F.col("i") + 1) * (F.col("n") - 1)
    over = W.partitionBy(*group, "i").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    numbered = inside.withColumn("upto", F.sum("c").over(over)).withColumn("at", ranks)
    on = F.col("i") == F.col("j")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"{g}_"))
    placed = numbered.join(stacked.withColumnsRenamed({"i": "j", **{g: f"{g}_" for g in group}}), on).withColumn("upto", F.col("upto") + F.col("below"))
    reached = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    first, last = F.floor("at"), F.ceil("at")
    found = placed.groupBy(*group, "i").agg(F.first("at").alias("at"), reached(first).alias("a"), reached(last).alias("z"), (F.first("below") <= F.first(first)).alias("sure"))
    sure = F.col("sure") & F.col("a").isNotNull() & F.col("z").isNotNull()
    quantile = F.when(sure, F.col("a") + (F.col("z") - F.col("a")) * (F.col("at") - F.floor("at"))).otherwise(F.raise_error(F.lit("a bracket misses its rank")).cast("double"))
    return found.select(*[F.col(g).alias(c) for g, c in zip(group, by, strict=True)], F.element_at(F.array(*map(F.lit, map(float, fractions))), F.col("i") + 1).alias("fraction"), quantile.alias("quantile"))
