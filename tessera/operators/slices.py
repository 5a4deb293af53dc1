"""Slices of time for keys that hold too many rows for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.names import free_names

#: Rows of one key that a task takes without more ado.
LEAST = 1_000_000


def _reached(bounds: Column, n: int, time: Column) -> Column:
    """How many of ``n`` ascending bounds are at or before ``time``, by binary search."""
    steps = F.lit([1 << s for s in range(n.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= n) & (F.get(bounds, p + s - 1) <= time), p + s).otherwise(p))


def with_slices(rows: DataFrame, on: list[str], time: str, least: int = LEAST, parts: int | None = None, cut: str = "_cut", slice_: str = "_slice") -> tuple[DataFrame, int]:
    """``rows`` with ``cut``, whether their key is cut, and ``slice_``, the number of their slice; and how many keys are cut.

    A key is cut if it has more than ``least`` rows and more than one in ``parts`` of all,
    so that there are fewer such keys than parts, by default the shuffle partitions.
    Slices are ranges of time that hold about one in ``parts`` of those keys' rows
    together; rows of one time share a slice, and a null time is in the first. Other
    keys have slice 0 alone. Rows are counted, and by key if there are more than
    ``least``, which reads them once more; only keys that are cut reach the driver.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = rows.count() if parts > 1 else 0
    keys = rows.select(*on)
    hot = []
    if total > least:
        hot = keys.groupBy(*on).agg(F.count(F.lit(1))).toDF(*on, "count of rows").where(F.col("count of rows") > max(least, total // parts)).select(*on).collect()
    if not hot:
        return rows.withColumns({cut: F.lit(False), slice_: F.lit(0)}), 0
    found, at, *names = free_names("found bounds " + " ".join(f"key{i}" for i in range(len(on))), rows, also=[cut, slice_])
    table = F.broadcast(spark.createDataFrame(hot, keys.schema).toDF(*names).withColumn(found, F.lit(True)))
    match = F.lit(True)
    for c, name in zip(on, names, strict=True):
        match = match & F.col(c).eqNullSafe(F.col(name))
    marked = rows.join(table, match, "left").withColumn(cut, F.col(found).isNotNull()).drop(found, *names)
    bounds = marked.where(F.col(cut)).agg(F.percentile_approx(time, [i / parts for i in range(1, parts)])).scalar()
    placed = marked.withColumn(at, bounds)
    inside = F.col(cut) & F.col(time).isNotNull()
    return placed.withColumn(slice_, F.when(inside, _reached(F.col(at), parts - 1, F.col(time))).otherwise(0)).drop(at), len(hot)
