"""Funnels of a stream, as states of values, lists and maps that timers work off and evict."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.names import free_names

#: The state store that transformWithState needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


#: Groups of keys by hash; a checkpoint keeps to its number.
GROUPS = 4096


class Funnel(StatefulProcessor):
    """Steps that follow each other within ``within_us``, taken in order of event time however rows arrive.

    Each call for a state crosses to the JVM, so keys are taken in groups, whose states are read
    and written together. Rows wait in a list until the watermark has passed them, so that late
    ones are put in their place, and repeated ones count once. The map holds the latest row of
    each key and step that has its step before it in time, while a next step may still follow;
    the last step ends a funnel if it is the first of its kind since the latest row of the step
    before. The value counts each key's funnels. A timer stands where the next row is due, or
    where the map or a count runs out; with nothing else left of a key its count goes with the
    last funnel's ``keep_us``.
    """

    def __init__(self, key: str, steps: Sequence[str], within_us: int, keep_us: int):
        self.key, self.steps, self.within, self.keep = key, list(steps), within_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "own long, us long, id long, step int")
        self.reached = handle.getMapState("reached", "own long, step int", "us long, ids array<long>, times array<long>")
        self.done = handle.getValueState("done", "owns array<long>, ns array<long>, us array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        new = {r for b in rows for r in zip(b[self.key].tolist(), b["us"].tolist(), b["id"].tolist(), b["step"].tolist(), strict=True)}
        # Rows at or behind the watermark are late; Spark drops them, too, where it can.
        new = {r for r in new if r[1] > mark * 1000}
        if new:
            self.waiting.appendList(list(new))
            self.handle.registerTimer(self._after(min(r[1] for r in new), mark))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        held = list(map(tuple, self.waiting.get())) if self.waiting.exists() else []
        due, left = sorted({r for r in held if r[1] < mark * 1000}, key=lambda r: r[1:]), {r for r in held if r[1] >= mark * 1000}
        out = []
        done = {o: (n, us) for o, n, us in zip(*self.done.get(), strict=True)} if self.done.exists() else {}
        counted = dict(done)
        stage = {tuple(k): tuple(v) for k, v in self.reached.iterator()}
        before = dict(stage)
        for own, us, i, step in due:
            prior = stage.get((own, step - 1))
            near = step == 0 or prior is not None and us - prior[0] <= self.within
            path = ([*prior[1], i], [*prior[2], us]) if near and step else ([i], [us])
            if step == len(self.steps) - 1:
                stage.pop((own, step - 1), None)
                if near:
                    done[own] = done.get(own, (0, 0))[0] + 1, us
                    out.append((own, done[own][0], *path))
            elif near:
                stage[own, step] = us, *path
            else:
                stage.pop((own, step), None)
        # What is still to come is at the watermark or later.
        stage = {k: v for k, v in stage.items() if v[0] + self.within >= mark * 1000}
        for k in before.keys() - stage.keys():
            self.reached.removeKey(k)
        for k in (k for k in stage if stage[k] != before.get(k)):
            self.reached.updateValue(k, stage[k])
        busy = {r[0] for r in left} | {k[0] for k in stage}
        done = {o: v for o, v in done.items() if o in busy or v[1] + self.keep >= mark * 1000}
        if done != counted:
            self.done.update(([*done], [v[0] for v in done.values()], [v[1] for v in done.values()])) if done else self.done.clear()
        if len(left) < len(held):
            self.waiting.put(list(left)) if left else self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        ends = [r[1] for r in left] + [v[0] + self.within for v in stage.values()] + [v[1] + self.keep for o, v in done.items() if o not in busy]
        if ends:
            self.handle.registerTimer(self._after(min(ends), mark))
        yield pd.DataFrame(out, columns=[self.key, "nth", "ids", "times"])

    @staticmethod
    def _after(us: int, mark: int) -> int:
        return max(us // 1000 + 1, mark + 1)

    def close(self) -> None:
        pass


def funnels(stream: DataFrame, key: str, time: str, id_col: str, kind: str, steps: Sequence[str], within_seconds: int, keep_seconds: int = 0, groups: int = GROUPS) -> DataFrame:
    """key (a long), nth (of the key's funnels while its state is kept), ids and times of each funnel.

    ``stream`` has a watermark on ``time``; the session's state store must be that of STORE.
    Rows of other kinds, and rows without key, time or id, take no part; rows that differ in
    nothing count once. groups: a task holds the waiting rows of one of so many groups of keys.
    Append mode.
    """
    rows = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(id_col).isNotNull() & F.col(kind).isin(*steps))
    number = F.coalesce(*[F.when(F.col(kind) == s, F.lit(i)) for i, s in enumerate(steps)])
    slim = rows.select(F.col(key).cast("long").alias(key), time, F.unix_micros(time).alias("us"), F.col(id_col).cast("long").alias("id"), number.alias("step"))
    processor = Funnel(key, steps, within_seconds * 1_000_000, keep_seconds * 1_000_000)
    (group,) = free_names("group", slim)
    slim = slim.withColumn(group, F.pmod(F.xxhash64(key), F.lit(groups)))
    out = slim.groupBy(group).transformWithStateInPandas(processor, f"{key} long, nth long, ids array<long>, times array<long>", "append", "eventTime")
    return out.withColumn("times", F.transform("times", lambda t: F.timestamp_micros(t)))
