"""State of streams over rows that come late: what it gives, and that it goes."""

import datetime as dt

from tessera.streaming.funnels import STORE, funnels
from tessera.streaming.runner import drain_arrivals

T0, MINUTE = dt.datetime(2024, 1, 1, 12), dt.timedelta(minutes=1)


def portions(spark, *rows):
    return [spark.createDataFrame([(k, None if m is None else T0 + m * MINUTE, i, s) for k, m, i, s in p], "k long, ts timestamp, i long, s string") for p in rows]


def states(seen):
    return lambda q: seen.append(sum(o.numRowsTotal for o in q.lastProgress.stateOperators))


def test_funnels(spark):
    """Steps that arrive in the wrong order, repeated rows, steps too far apart, a second purchase, a row behind the watermark."""
    first = [(1, 20, 3, "buy"), (1, 0, 1, "see"), (2, 0, 5, "see"), (2, 68, 6, "add"), (2, 69, 7, "buy"), (3, 0, 8, "buy"), (None, 0, 9, "see"), (4, None, 9, "see"), (4, 0, 9, "other")]
    second = [(1, 10, 2, "add"), (1, 10, 2, "add"), (1, 25, 4, "buy"), (5, 90, 10, "see")]
    third = [(5, 95, 11, "add"), (5, 100, 12, "buy"), (6, 400, 13, "see")]
    fourth = [(5, 110, 14, "buy"), (7, 100, 15, "see"), (7, 2000, 16, "other"), (8, 2000, 17, "see")]
    seen = []
    run = lambda s: funnels(s.withWatermark("ts", "1 hour"), "k", "ts", "i", "s", ["see", "add", "buy"], 1800)
    got = drain_arrivals(portions(spark, first, second, third, fourth), run, STORE, states(seen)).collect()
    assert sorted((r["k"], r["nth"], r["ids"], [(t - T0) / MINUTE for t in r["times"]]) for r in got) == [(1, 1, [1, 2, 3], [0, 10, 20]), (5, 1, [10, 11, 12], [90, 95, 100])]
    # Of all keys only the last one still waits: one row and its timer.
    assert max(seen) > seen[-1] and seen[-1] <= 4


def test_dedup_state_goes(spark):
    seen = []
    run = lambda s: s.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["i"])
    rows = portions(spark, [(1, 0, 1, "a"), (1, 0, 1, "a"), (1, 5, 2, "a")], [(1, 30, 1, "again"), (1, 300, 3, "a")], [(1, 20, 1, "late"), (1, 600, 4, "a")])
    got = drain_arrivals(rows, run, watch=states(seen)).collect()
    assert sorted((r["i"], r["s"]) for r in got) == [(1, "a"), (2, "a"), (3, "a"), (4, "a")]
    assert seen[-1] == 1 and seen[0] == 2


def test_a_client_is_joined_by_half_hours(spark, tmp_path, monkeypatch):
    """Rows of one client meet in their half hour and the next one alone, and borders and ties stay whole."""
    import duckdb

    from tessera.plans import streams

    half, start = 1800, dt.datetime(2024, 1, 1)
    moments = [k * half + o for k in range(48) for o in (-1, 0, 1)]
    rows = [(2 * i + j, start + dt.timedelta(seconds=s), start + dt.timedelta(seconds=s), 7, kind) for i, s in enumerate(moments) for j, kind in enumerate(("view", "purchase")) if (i + j) % 5]
    path = f"{tmp_path}/clicks.parquet"
    df = spark.createDataFrame(rows, "click_id long, ts timestamp, arrived_at timestamp, client_id long, kind string")
    df.withColumns({c: df[c].cast("timestamp_ntz") for c in ("ts", "arrived_at")}).coalesce(1).write.parquet(path)
    plans = []
    run = streams.drain_arrivals
    monkeypatch.setattr(streams, "drain_arrivals", lambda arrivals, query: run(arrivals, query, watch=lambda q: plans.append(q._jsq.explainInternal(False))))
    got = streams.stream_outer_join(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW clicks AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(streams.ORACLE_SQL["stream_outer_join"]).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) > 100
    assert all("StreamingSymmetricHashJoin [client_id#" in p and "slot#" in p for p in plans) and len(plans) == 4


def test_keys_of_a_group(spark):
    """Keys that share a state are told apart, their counts go on and end each by itself; calls for a state don't grow with the keys."""
    made = lambda t, ks: [(k, t + d, 10 * k + n, s) for k in ks for d, n, s in ((0, t * 1000 + 1, "see"), (10, t * 1000 + 2, "buy"))]
    rows = portions(spark, made(0, range(40)), made(200, range(0, 40, 2)), [(99, 1000, 1, "see")], made(1010, range(3)), [(99, 9000, 1, "see")])
    run = lambda s: funnels(s.withWatermark("ts", "1 hour"), "k", "ts", "i", "s", ["see", "buy"], 1800, 36_000, groups=1)
    seen = []
    got = drain_arrivals(rows, run, STORE, states(seen)).collect()
    want = [(k, 1) for k in range(40)] + [(k, 2) for k in range(0, 40, 2)]
    assert sorted((r["k"], r["nth"]) for r in got if r["times"][0] < T0 + 900 * MINUTE) == sorted(want)
    # The counts of even keys run out 600 minutes after minute 210, before minute 1010.
    assert sorted((r["k"], r["nth"]) for r in got if r["times"][0] > T0 + 900 * MINUTE) == [(0, 1), (1, 1), (2, 1)]
    # One list row, one timer and no count: 40 keys are one state.
    assert max(seen) < 60 and seen[-1] <= 4


def test_sessions_of_a_group(spark):
    """Open sessions of 40 keys are two states at most, and each key's sessions are its own."""
    from tessera.streaming.sessions import closed_sessions

    first = [(k, m, 1, "a") for k in range(40) for m in (0, 10, 25 if k % 2 else 60)]
    seen = []
    run = lambda s: closed_sessions(s.withWatermark("ts", "1 hour"), "k", "ts", 1800, groups=2)
    got = drain_arrivals(portions(spark, first, [(99, 5000, 1, "a")]), run, watch=states(seen)).collect()
    want = [(k, m, n) for k in range(40) for m, n in ([(0, 3)] if k % 2 else [(0, 2), (60, 1)])]
    assert sorted((r["k"], round((r["start"] - T0) / MINUTE), r["n"]) for r in got) == sorted(want)
    assert max(seen) <= 2 and seen[-1] == 1
