"""Sessions of a stream, kept as state of its own and closed by timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.names import free_names


#: Groups of keys by hash; a checkpoint keeps to its number.
GROUPS = 4096


def closed_sessions(stream: DataFrame, key: str, time: str, gap_seconds: int, groups: int = GROUPS) -> DataFrame:
    """key, start, end and n of each session, once the stream's watermark has passed its end.

    A session holds rows of one key (a long) that are less than ``gap_seconds`` apart; its
    end is that much after its last row. ``stream`` has a watermark on ``time``; rows behind
    it are dropped. Keys are taken in so many groups, as each call for a state has its price.
    A group's state is its keys' open sessions, whose earliest end is its timer; without an
    open session the state goes. Append mode.
    """
    gap = gap_seconds * 1_000_000

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened = list(zip(*state.get, strict=True)) if state.exists else []
        mark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for b in batches:
                # Spark drops what an earlier micro-batch's watermark had passed; here this one's counts.
                opened += [(k, t, t, 1) for k, t in zip(b[key].tolist(), b["us"].tolist(), strict=True) if t // 1000 >= mark]
        merged: list[tuple[int, int, int, int]] = []
        for own, start, last, n in sorted(opened):
            if merged and own == merged[-1][0] and start < merged[-1][2] + gap:
                merged[-1] = (own, merged[-1][1], max(merged[-1][2], last), merged[-1][3] + n)
            else:
                merged.append((own, start, last, n))
        done = [s for s in merged if (s[2] + gap) // 1000 < mark]
        left = [s for s in merged if (s[2] + gap) // 1000 >= mark]
        if left:
            state.update(tuple(list(c) for c in zip(*left, strict=True)))
            # A timer must lie beyond the watermark.
            state.setTimeoutTimestamp(max(min(s[2] + gap for s in left) // 1000, mark + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [s[0] for s in done], "start": [s[1] for s in done], "end": [s[2] + gap for s in done], "n": [s[3] for s in done]}).astype("int64")

    rows = stream.select(F.col(key).cast("long").alias(key), time, F.unix_micros(time).alias("us")).where(F.col(key).isNotNull())
    (group,) = free_names("group", rows)
    rows = rows.withColumn(group, F.pmod(F.xxhash64(key), F.lit(groups)))
    kept = "owns array<long>, starts array<long>, lasts array<long>, counts array<long>"
    out = rows.groupBy(group).applyInPandasWithState(step, f"{key} long, start long, end long, n long", kept, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumns({c: F.timestamp_micros(c) for c in ("start", "end")})
