"""Changes of rows by key: the state that they lead to, and the history of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.names import free_names
from tessera.operators.slices import LEAST, with_slices
from tessera.operators.written import written


def _known(changes: DataFrame, on: Sequence[str], time: str) -> DataFrame:
    for c in (*on, time):
        changes = changes.where(F.col(c).isNotNull())
    return changes


def _said(order: Sequence[str], values: Sequence[str], deleted: Column | str) -> Column:
    """What a change says, after what ranks it: its values, or null for a deletion."""
    gone = F.coalesce(F.expr(deleted) if isinstance(deleted, str) else deleted, F.lit(False))
    return F.struct(*order, gone.alias("gone"), F.when(~gone, F.struct(*values)).alias("values"))


def sayings(changes: DataFrame, on: Sequence[str], time: str, order: Sequence[str], values: Sequence[str], deleted: Column | str, out: str = "values") -> DataFrame:
    """``on``, ``time`` and ``out``, a struct of ``values``: what holds of a key from that time on; null from a deletion on.

    Of changes of one key and time that with the greatest ``order`` counts (nulls least),
    then a deletion, then the greatest values; so changes that come again, or late, alter
    nothing. Changes without a key or a time say nothing. One aggregate, combined before its
    shuffle: no key's changes are gathered. ``deleted`` is a condition, as a column or SQL; null is no deletion.
    """
    best = _known(changes, on, time).groupBy(*on, time).agg(F.max(_said(order, values, deleted)).alias(out))
    return best.select(*on, time, F.col(f"{out}.values").alias(out))


def apply_changes(base: DataFrame, changes: DataFrame, on: Sequence[str], base_time: str, time: str, order: Sequence[str], values: Sequence[str], deleted: Column | str) -> DataFrame:
    """``base`` after ``changes``: rows get the values and the time of their key's last change, if it is after their own time.

    A deletion removes them; a key that ``base`` hasn't is entered, with null in the columns
    that changes don't have, unless its last change is a deletion. Rows without a time take any change;
    those without a key stay. Repeated rows of a key are changed alike. Applied twice, the result is the same:
    but a deleted row, of which ``base`` no longer knows when, would be entered by changes older than its deletion
    if the deletion itself were not among them.

    A key's last change is an aggregate that is combined before its shuffle. It is joined to ``base`` by one row a
    key, so that a key with very many rows of ``base`` can be split.
    """
    last, *names = free_names("last " + " ".join(f"key{i}" for i in range(len(on))), base)
    ranked = F.max(F.struct(F.col(time).alias("at"), _said(order, values, deleted).alias("said")))
    keys = [F.col(c).alias(n) for c, n in zip(on, names, strict=True)]
    latest = written(_known(changes, on, time).groupBy(*keys).agg(ranked.alias(last)), "latest")
    match = F.lit(True)
    for c, n in zip(on, names, strict=True):
        match = match & (F.col(c) == F.col(n))
    newer = F.coalesce(F.col(f"{last}.at") > F.col(base_time), F.col(last).isNotNull())
    new = {base_time: F.col(f"{last}.at"), **{c: F.col(f"{last}.said.values.{c}") for c in values}}
    joined = base.join(latest, match, "left").where(~(newer & F.coalesce(F.col(f"{last}.said.gone"), F.lit(False))))
    changed = joined.select(*[F.when(newer, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in base.columns])
    held = base.select(*on).distinct()
    missing = latest.where(~F.col(f"{last}.said.gone")).join(held, match, "left_anti")
    own = dict(zip(on, map(F.col, names), strict=True)) | new
    entered = missing.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in base.schema])
    return changed.unionByName(entered)


def history(
    changes: DataFrame, on: Sequence[str], time: str, order: Sequence[str], values: Sequence[str], deleted: Column | str, since: str = "valid_from", until: str = "valid_to", least: int = LEAST, parts: int | None = None
) -> DataFrame:
    """Versions of each key: ``on``, ``since``, ``until`` (null: it still holds) and ``values``.

    A version holds from its change to the next that says otherwise; changes that repeat what
    holds make none, and after a deletion there is a gap. ``sayings`` says which change counts.

    A key with too many rows for one task is cut into slices of time (see ``with_slices``):
    the last saying before a slice is repeated at its start, and the first version after it at its end.
    """
    said, cut, slice_, own, last, before = free_names("said cut slice own last before", also=[*on, time, *values])
    rows = written(sayings(changes, on, time, order, values, deleted, said), "sayings")
    rows, n_cut = with_slices(rows, list(on), time, least, parts, cut, slice_)
    rows = rows.withColumn(own, F.lit(True))
    ends, along = [*on, slice_], W.partitionBy(*on).orderBy(slice_)
    if n_cut:
        # At most one row for each key that is cut and slice, here and below.
        carried = rows.where(F.col(cut)).groupBy(*ends).agg(F.max_by(F.struct(time, said), time).alias(last)).withColumn(before, F.lag(last).over(along)).where(F.col(before).isNotNull())
        rows = rows.unionByName(carried.select(*ends, f"{before}.*", F.lit(False).alias(own), F.lit(True).alias(cut)))
    over = W.partitionBy(*on, slice_).orderBy(time)
    changed = rows.withColumn(last, F.lag(said).over(over)).where(F.col(own) & ~F.col(said).eqNullSafe(F.col(last))).drop(last)
    if n_cut:
        changed = written(changed, "versions")
        follow = changed.where(F.col(cut)).groupBy(*ends).agg(F.min(time).alias(last)).withColumn(time, F.lead(last).over(along)).where(F.col(time).isNotNull())
        changed = changed.unionByName(follow.select(*ends, time, F.lit(False).alias(own)), allowMissingColumns=True)
    versions = changed.withColumn(last, F.lead(time).over(over)).where(F.col(own) & F.col(said).isNotNull())
    return versions.select(*on, F.col(time).alias(since), F.col(last).alias(until), *[F.col(f"{said}.{c}").alias(c) for c in values])
