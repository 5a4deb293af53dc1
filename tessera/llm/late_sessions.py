"""Sessions of events that arrive in batches, late ones merging what stood before.

Time stamps of a user that are at most ``gap`` apart share a session. The driver
takes the batches in ascending order. Each step reads two written tables, the
standing sessions and the batch's micro-sessions, re-islands them with one shuffle
by user, and writes the standing sessions that result together with the versions
that are over: those that a new version has retracted, and those that no later
batch can reach. A step is a folder that counts once its write has succeeded, so a
driver that starts again goes on after the last one, and no plan grows with the
number of batches.

A micro-session is what a batch holds of one user in one stretch of ``gap`` seconds,
made by partial aggregates. However many events a user has, a step sees at most one
row of that user for each ``gap`` of the time that the batch spans, besides the
sessions that stand there; so no user is one task's burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scratch

_FIELDS = ("batch", "start_s", "end_s", "n_events", "n_new", "n_retracted", "h_sum", "retracted_batch", "retracted_start_s")
_ROW = ", ".join(f"{c} long" for c in ("user", *_FIELDS))


def _floor(value: Column, by: int) -> Column:
    """The floor of value / by on longs."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by).cast("long"))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """user, batch, second and h of each turn, by the fold of ids that the query states.

    A row without turn is no event; nor is one without conv_id, as it has neither user
    nor time. One whose seconds no long can hold has no second. Repeated rows are events
    of their own. Other columns aren't read.
    """
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn")).where("conv IS NOT NULL AND turn IS NOT NULL")
    hashed = ids.select("conv", "turn", F.crc32(F.col("conv").cast("string")).alias("c"), F.crc32(F.concat_ws(":", F.col("conv").cast("string"), F.col("turn").cast("string"))).alias("h"))
    c, h = F.col("c"), F.col("h")
    timed = hashed.select((2 * _floor(F.col("conv"), 8) + c % 2).alias("user"), F.try_add(F.try_multiply(F.lit(300).cast("long"), F.col("turn")), _floor(c, 2) % 7200 + h % 600).alias("second"), "h", _floor(h, 600).alias("g"))
    late = F.when(F.col("g") % 3 == 0, F.col("g") % 4).otherwise(0)
    return timed.select("user", (_floor(F.col("second"), 1800) + late).cast("long").alias("batch"), "second", "h")


def micro_sessions(events: DataFrame, gap: int) -> DataFrame:
    """user, batch, start_s, end_s, n_events and h_sum of each user, batch and stretch of ``gap`` seconds."""
    stretch = _floor(F.col("second"), max(gap, 1))
    rows = events.where("user IS NOT NULL AND batch IS NOT NULL AND second IS NOT NULL")
    sums = rows.groupBy("user", "batch", stretch.alias("stretch")).agg(F.min("second").alias("start_s"), F.max("second").alias("end_s"), F.count(F.lit(1)).alias("n_events"), F.coalesce(F.sum("h"), F.lit(0)).alias("h_sum"))
    return sums.drop("stretch")


def re_island(standing: DataFrame, fresh: DataFrame, batch: int, gap: int) -> DataFrame:
    """Rows of ``_FIELDS`` after a batch: untouched sessions, new versions, and the ones that these retract."""
    old = F.struct(*[F.col(c) for c in _FIELDS])
    both = standing.select("user", "start_s", "end_s", "n_events", "h_sum", old.alias("old")).unionByName(fresh.select("user", "start_s", "end_s", "n_events", "h_sum", F.lit(None).cast(standing.select(old.alias("x")).schema["x"].dataType).alias("old")))
    along = W.partitionBy("user").orderBy("start_s", "end_s")
    reach = F.max("end_s").over(along.rowsBetween(W.unboundedPreceding, -1))
    starts = F.when(F.col("start_s") - reach <= gap, 0).otherwise(1)
    marked = both.withColumn("starts", starts).withColumn("island", F.sum("starts").over(along.rowsBetween(W.unboundedPreceding, 0)))
    whole = marked.groupBy("user", "island").agg(
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.sum("n_events").alias("n_events"), F.sum("h_sum").alias("h_sum"),
        F.sum(F.when(F.col("old").isNull(), F.col("n_events"))).alias("n_new"), F.collect_list("old").alias("olds"),
    )
    null = F.lit(None).cast("long")
    version = F.struct(F.lit(batch).cast("long").alias("batch"), "start_s", "end_s", "n_events", "n_new", F.size("olds").cast("long").alias("n_retracted"), "h_sum", null.alias("retracted_batch"), null.alias("retracted_start_s"))
    retired = F.transform("olds", lambda o: F.struct(*[o[c].alias(c) for c in _FIELDS[:-2]], F.lit(batch).cast("long").alias("retracted_batch"), F.col("start_s").alias("retracted_start_s")))
    return whole.select("user", F.inline(F.when(F.col("n_new").isNull(), F.col("olds")).otherwise(F.concat(F.array(version), retired))))


class SessionStore:
    """Standing sessions and their versions below ``path``, a folder that all executors share.

    ``merge`` takes batches in ascending order; one that is not above the last merged
    batch is in the store already and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, gap: int = 240):
        if gap < 0:
            raise ValueError("gap must not be negative")
        self.spark, self.path, self.gap = spark, path.rstrip("/"), gap
        self.step, self.last = -1, None
        fs, p = scratch.filesystem(spark, f"{self.path}/step")
        for s in fs.listStatus(p.getParent()) if fs.exists(p.getParent()) else []:
            at = s.getPath()
            if fs.exists(scratch.filesystem(spark, f"{at.toString()}/_SUCCESS")[1]):
                step, batch = at.getName().removeprefix("step=").split("of", 1)
                if int(step) > self.step:
                    self.step, self.last = int(step), int(batch)

    def _folder(self, step: int, batch: int) -> str:
        return f"{self.path}/step={step:09d}of{batch}"

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.schema(f"{_ROW}, done boolean").parquet(folder)

    def merge(self, batch: int, fresh: DataFrame, horizon: int | None = None) -> bool:
        """Merge a batch's micro-sessions; False, and no change, if it was merged before.

        horizon: the least second of any event of later batches, if that is known; what
        ends over ``gap`` before it is final and leaves the standing sessions. Without it
        all sessions stand, so that an event as late as may be still finds its own.
        """
        if self.last is not None and batch <= self.last:
            return False
        standing = self._read(self._folder(self.step, self.last)).where("NOT done") if self.last is not None else self.spark.createDataFrame([], _ROW)
        rows = re_island(standing.select("user", *_FIELDS), fresh, batch, self.gap)
        final = F.lit(False) if horizon is None else F.col("end_s") + self.gap < horizon
        rows.withColumn("done", F.col("retracted_batch").isNotNull() | final).write.mode("overwrite").partitionBy("done").parquet(self._folder(self.step + 1, batch))
        before, self.step, self.last = self.last and self._folder(self.step, self.last), self.step + 1, batch
        if before:
            fs, p = scratch.filesystem(self.spark, f"{before}/done=false")
            fs.delete(p, True)
        return True

    def versions(self) -> DataFrame:
        """Every version so far: those that are over, and the standing ones."""
        if self.last is None:
            return self.spark.createDataFrame([], _ROW)
        schema = f"{_ROW}, step string, done boolean"
        rows = self.spark.read.schema(schema).parquet(self.path)
        # Steps that a dead driver left unfinished are later than the last one that counts.
        return rows.where((F.col("done") | (F.col("step") == f"{self.step:09d}of{self.last}")) & (F.substring("step", 1, 9) <= f"{self.step:09d}")).select("user", *_FIELDS)


def late_sessions(events: DataFrame, gap: int = 240, path: str | None = None) -> DataFrame:
    """Every version of every session of ``events`` (user, batch, second and h, all long), batch by batch.

    user, batch (that made the version), start_s and end_s (its first and last event),
    n_events, n_new (events of that batch), n_retracted (standing sessions that it
    replaced), h_sum (of all its events), retracted_batch and retracted_start_s (of the
    version that replaced it; null if it stands at the end).

    Events with a null user, batch or second take no part; a null h adds nothing. Events
    of one second, and repeated rows, each count. An empty table gives no rows; other
    columns aren't read. The driver gets two numbers for each batch. path: where to keep
    the steps; with the path of an earlier run over the same events it goes on from there.
    """
    spark = events.sparkSession
    micro = micro_sessions(events.select("user", "batch", "second", "h"), gap)
    # By batch, so that a step reads its own files alone; large batches are split, small ones share a task.
    folder = scratch.new_path(spark, "micro")
    micro.hint("rebalance", "batch").write.partitionBy("batch").parquet(folder)
    written = spark.read.schema("user long, start_s long, end_s long, n_events long, h_sum long, batch long").parquet(folder)
    firsts = sorted((r["batch"], r["first"]) for r in written.groupBy("batch").agg(F.min("start_s").alias("first")).collect())
    store = SessionStore(spark, path or scratch.new_path(spark, "sessions"), gap)
    for i, (batch, _) in enumerate(firsts):
        horizon = min((first for _, first in firsts[i + 1 :]), default=None)
        store.merge(batch, written.where(F.col("batch") == batch).drop("batch"), horizon)
    fs, p = scratch.filesystem(spark, folder)
    fs.delete(p, True)
    return store.versions()
