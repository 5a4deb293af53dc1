"""As-of join: each left row with the latest right row before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.names import free_names
from tessera.operators.slices import LEAST, with_slices


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value_cols: list[str], strict: bool = True, least: int = LEAST, parts: int | None = None) -> DataFrame:
    """``left`` with ``right``'s value columns from the latest row whose time is before (or at, if not strict).

    One shuffle by ``on``: both sides are united and a window carries the last right
    row forward, so no pair of rows is ever formed. Of right rows with one time the
    greatest in ``value_cols`` counts. Left rows without a match get nulls.

    A key with too many rows for one task is cut into slices of time (see
    ``with_slices``), and the last right row before a slice is repeated at its start.
    """
    t, side, own, lefts, rights, cut, slice_, latest, before, last = free_names("t side own left right cut slice latest before last", also=on)
    # Rows with equal times: right rows come after left ones if strict, before them if not.
    rank = (1, 0) if strict else (0, 1)
    them = right.select(*on, F.col(right_time).alias(t), F.lit(rank[0]).alias(side), F.lit(None).alias(lefts), F.struct(*value_cols).alias(rights))
    us = left.select(*on, F.col(left_time).alias(t), F.lit(rank[1]).alias(side), F.struct(*[F.col(c) for c in left.columns]).alias(lefts), F.lit(None).alias(rights))
    both, n_cut = with_slices(us.unionByName(them), on, t, least, parts, cut, slice_)
    both = both.withColumn(own, F.lit(True))
    if n_cut:
        # At most one row for each key that is cut and slice.
        row = F.when(F.col(rights).isNotNull(), F.struct(t, side, rights))
        ends = both.where(F.col(cut)).groupBy(*on, slice_).agg(F.max(row).alias(latest))
        earlier = W.partitionBy(*on).orderBy(slice_).rowsBetween(W.unboundedPreceding, -1)
        carried = ends.withColumn(before, F.last(latest, ignorenulls=True).over(earlier)).where((F.col(slice_) > 0) & F.col(before).isNotNull())
        both = both.unionByName(carried.select(*on, f"{before}.*", slice_, F.lit(False).alias(own)), allowMissingColumns=True)
    over = W.partitionBy(*on, slice_).orderBy(own, t, side, rights).rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn(last, F.last(rights, ignorenulls=True).over(over)).where(F.col(lefts).isNotNull())
    return found.select(f"{lefts}.*", *[F.col(f"{last}.{c}").alias(c) for c in value_cols])
