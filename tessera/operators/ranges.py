"""Range joins as equi-joins on buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.names import free_names


def interval_join(points: DataFrame, intervals: DataFrame, point: Column, start: Column, end: Column, width: float, on: list[str] | None = None) -> DataFrame:
    """All pairs with start <= point < end (and equal ``on``); numeric columns.

    An interval belongs to the level of its length: buckets of ``width``, or of the first of
    twice, four times, ... that which is at least as long. There it touches two buckets, or
    three by rounding, whatever its length, and a point has one bucket for each level that
    any interval has. So each pair meets once, by a join that hashes. Choose a width near
    the usual length; then there is one level. Nulls and NaN match nothing, infinite ends
    are a level of their own.
    """
    on = on or []
    bucket, level, p, s, e = free_names("bucket level p s e", points, intervals)

    def place(value: Column) -> Column:
        # Division and floor keep order, so a point never lies outside the buckets from its interval's start to its end.
        return F.floor(value.cast("double") / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col(level))))

    spans = intervals.withColumn(s, start).withColumn(e, end).where((F.col(s) < F.col(e)) & ~F.isnan(F.col(e).cast("double")))
    ratio = (F.col(e).cast("double") - F.col(s).cast("double")) / float(width)
    spans = spans.withColumn(level, F.when(ratio <= 1, 0).otherwise(F.least(F.ceil(F.log2(ratio)), F.lit(1100))).cast("int"))
    levels = sorted(r[0] for r in spans.select(level).distinct().collect())
    # The ends of an infinite interval are in bucket 0 or none.
    right = spans.withColumn(bucket, F.explode(F.sequence(F.coalesce(place(F.col(s)), F.lit(0)), F.coalesce(place(F.col(e)), F.lit(0)))))
    left = points.withColumn(p, point).withColumn(level, F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn(bucket, place(F.col(p)))
    return left.join(right, [*on, level, bucket]).where((F.col(p) >= F.col(s)) & (F.col(p) < F.col(e))).drop(bucket, level, p, s, e)


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: float, on: list[str] | None = None) -> DataFrame:
    """All pairs of intervals [start, end) that have a point in common (and equal ``on``); empty ones have none.

    Either the right one starts in the left one, or the left one after that in the right one.
    """
    on = on or []
    a, b = left.where(left_span[0] < left_span[1]), right.where(right_span[0] < right_span[1])
    names = [*on, *[c for c in left.columns if c not in on], *[c for c in right.columns if c not in on]]
    later = interval_join(b, a, right_span[0], left_span[0], left_span[1], width, on).select(names)
    earlier = interval_join(a, b, left_span[0], right_span[0], right_span[1], width, on).where(left_span[0] > right_span[0]).select(names)
    return later.unionByName(earlier)
