"""Gapless positions inside groups of any size, without a task per group.

Rows of a group are dealt over ``parts`` sub-groups by a hash; counts of the
sub-groups give each its offset, and a window numbers the rows inside one.
A group with a third of all rows is thus numbered by ``parts`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def spread(parts: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int")


def positions(df: DataFrame, counted: DataFrame, group: list[str], by: list[str], order: list[str], parts: int, out: str, running: bool = False) -> DataFrame:
    """``df`` with ``out``, 0 to n-1 inside each ``group``.

    counted: the same rows, with the columns of ``group`` and ``by`` at least; it is
    read on its own, so it may be a cheaper scan than ``df``. running: numbers go on
    from group to group, in the order of ``group``; then every column of ``group``
    has few values. Groups may be null. Rows equal in ``order`` are numbered anyhow.
    """
    sub = spread(parts, *by)
    sizes = counted.groupBy(*group, sub.alias("_sub")).agg(F.count(F.lit(1)).alias("_n"))
    over = W.orderBy(*group, "_sub") if running else W.partitionBy(*group).orderBy("_sub")
    offsets = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_sub").alias("_s"), (F.sum("_n").over(over.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_off"))
    inner = W.partitionBy(*group, "_sub").orderBy(*order)
    numbered = df.withColumn("_sub", sub).withColumn("_rn", F.row_number().over(inner).cast("long") - 1)
    on = F.col("_sub") == F.col("_s")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = numbered.join(offsets, on)
    return joined.withColumn(out, F.col("_off") + F.col("_rn")).drop("_sub", "_s", "_rn", "_off", *[f"_g{i}" for i in range(len(group))])
