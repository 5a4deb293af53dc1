"""Sessions of events separated by gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.names import free_names
from tessera.operators.slices import LEAST, with_slices


def _seconds(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp")) / 1e6


def sessionize(
    events: DataFrame, by: list[str], time: str, gap_seconds: float, order: list[str] | None = None, out: str = "session", least: int = LEAST, parts: int | None = None
) -> DataFrame:
    """``events`` with the number of its session, from 1: a new one starts after a gap of at least ``gap_seconds``.

    A key with too many rows for one task is cut into slices of time (see
    ``with_slices``), whose sessions are numbered on from those of the slices before.
    """

    def starts(gap: Column) -> Column:
        return F.when(gap < gap_seconds, 0).otherwise(1)

    cut, slice_, new, so_far, first, last, same, before, of, *names = free_names("cut slice new sum first last same before of " + " ".join(f"key{i}" for i in range(len(by))), events, also=[out])
    rows, n_cut = with_slices(events, by, time, least, parts, cut, slice_)
    over = W.partitionBy(*by, slice_).orderBy(time, *(order or []))
    seconds = _seconds(F.col(time))
    rows = rows.withColumn(new, starts(seconds - F.lag(seconds).over(over)))
    rows = rows.withColumn(out, F.sum(new).over(over.rowsBetween(W.unboundedPreceding, 0)))
    if n_cut:
        # One row for each key that is cut and slice; the first row of a slice counts as new in it.
        ends = rows.where(F.col(cut)).groupBy(*by, slice_).agg(F.sum(new).alias(so_far), F.min(time).alias(first), F.max(time).alias(last))
        along = W.partitionBy(*by).orderBy(slice_)
        # A slice goes on with the session before it if its first row follows the last one within the gap.
        ends = ends.withColumn(same, 1 - starts(_seconds(F.col(first)) - _seconds(F.lag(last).over(along))))
        ends = ends.withColumn(before, F.sum(F.col(so_far) - F.col(same)).over(along.rowsBetween(W.unboundedPreceding, 0)) - F.col(so_far))
        ends = ends.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col(slice_).alias(of), before)
        match = F.col(cut) & (F.col(slice_) == F.col(of))
        for c, n in zip(by, names, strict=True):
            match = match & F.col(c).eqNullSafe(F.col(n))
        rows = rows.join(ends, match, "left").withColumn(out, F.col(out) + F.coalesce(before, F.lit(0))).drop(before, of, *names)
    return rows.drop(new, cut, slice_)
