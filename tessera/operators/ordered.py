"""Positions, ranks and running sums over a whole table, without a window in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.names import free_names
from tessera.operators.slices import LEAST
from tessera.operators.written import written


def running_totals(rows: DataFrame, order: Sequence[str], sums: dict[str, str], position: str = "position", parts: int | None = None) -> DataFrame:
    """``rows`` with ``position``, from 1 in the order of ``order``, and running sums, this row's value included.

    sums: a new column for each column that is summed (longs or decimals; null adds nothing).
    Rows are dealt over ``parts`` ranges of the order and written; each range's count and sums
    are carried on to the next, which takes one small row for each range. Rows that are equal in
    ``order`` are one range's and numbered anyhow, so end it with a column that tells them apart.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, part, n, *before = free_names("at part n " + " ".join(f"before{i}" for i in range(len(sums))), rows, also=[position, *sums])
    # The number is the range's and the row's place in it; written, as another run might cut other ranges.
    placed = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND((1 << 33) - 1))
    totals = placed.groupBy(part).agg(F.count(F.lit(1)).alias(n), *[F.coalesce(F.sum(c), F.lit(0)).alias(b) for c, b in zip(sums.values(), before, strict=True)])
    along = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(F.col(part), *[F.coalesce(F.sum(c).over(along), F.lit(0)).alias(c) for c in (n, *before)])
    inside = W.partitionBy(part).orderBy(at).rowsBetween(W.unboundedPreceding, 0)
    own = placed.withColumns({new: F.coalesce(F.sum(c).over(inside), F.lit(0)) for new, c in sums.items()})
    joined = own.join(F.broadcast(carried), part)
    return joined.withColumns({position: F.col(n) + F.col(at) + 1, **{new: F.col(new) + F.col(b) for new, b in zip(sums, before, strict=True)}}).drop(at, part, n, *before)


def ranks(rows: DataFrame, by: str, tie: str, rank: str = "rank", parts: int | None = None) -> DataFrame:
    """``rows`` with their rank by ``by`` over the whole table; equal rows share the first of their positions. tie: a column that tells them apart."""
    at, first, key = free_names("at first key", rows, also=[rank])
    numbered = written(running_totals(rows, [by, tie], {}, at, parts), "numbered")
    lowest = written(numbered.groupBy(F.col(by).alias(key)).agg(F.min(at).alias(first)), "first")
    return numbered.join(lowest, F.col(by).eqNullSafe(F.col(key))).withColumn(rank, F.col(first)).drop(at, first, key)


def frame_counts(rows: DataFrame, by: Sequence[str], time: Column, back: int, out: str = "n", least: int = LEAST, parts: int | None = None) -> DataFrame:
    """``rows`` with the number of rows of their key whose time (a long) is from ``back`` before theirs to theirs.

    A window, unless a key has more than ``least`` rows and one in ``parts`` of all. Then each
    row gives three entries, one that counts at its time and one before and one after all that
    its frame holds, in one order of keys and times that ranges of any cut share; the count is
    the difference of two running totals. Rows without time are each other's frame.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, number, kind, whole, so_far, place = free_names("at number kind row total place", rows, also=[out, *by])
    timed = rows.withColumn(at, time.cast("long"))
    total = rows.count()
    if total <= least or timed.groupBy(*by).count().where(F.col("count") > max(least, total // parts)).isEmpty():
        over = W.partitionBy(*by).orderBy(at).rangeBetween(-back, 0)
        return timed.withColumn(out, F.count(F.lit(1)).over(over)).drop(at)
    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    entry = lambda t, k, r: F.struct(t.alias(at), F.lit(k).alias(kind), F.lit(k % 2).cast("long").alias("counts"), r.alias(whole))
    none = F.lit(None).cast(timed.select(row.alias(whole)).schema[whole].dataType)
    entries = F.array(entry(F.col(at) - back, 0, none), entry(F.col(at), 1, none), entry(F.col(at), 2, row))
    keys = [f"key{i}" for i in range(len(by))]
    spread = timed.withColumn(number, F.monotonically_increasing_id()).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], number, F.inline(entries))
    numbered = running_totals(spread, [*keys, at, kind, number], {so_far: "counts"}, place, parts)
    ends = [F.max(F.when(F.col(kind) == k, F.col(so_far))) for k in (0, 2)]
    found = numbered.where(F.col(kind) != 1).groupBy(number).agg(F.first(whole, ignorenulls=True).alias(whole), (ends[1] - ends[0]).alias(out))
    return found.select(f"{whole}.*", out)
