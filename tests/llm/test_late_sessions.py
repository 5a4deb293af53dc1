import random
import zlib

import pytest
from parity import compare, connect

from tessera.llm import late_sessions, queries, scratch

SF = "/root/testdata/sf0.01"


def brute(events, gap):
    """Versions of (user, batch, second, h) events, session by session."""
    out = []
    for user in {e[0] for e in events}:
        own, standing = sorted((e for e in events if e[0] == user), key=lambda e: e[2]), []
        for b in sorted({e[1] for e in own}):
            islands = []
            for e in (e for e in own if e[1] <= b):
                if islands and e[2] - islands[-1][-1][2] <= gap:
                    islands[-1].append(e)
                else:
                    islands.append([e])
            for island in islands:
                new = sum(e[1] == b for e in island)
                if new:
                    lo, hi = island[0][2], island[-1][2]
                    inside = [v for v in standing if lo <= v[2] and v[3] <= hi]
                    for v in inside:
                        v[8:] = [b, lo]
                        standing.remove(v)
                    standing.append([user, b, lo, hi, len(island), new, len(inside), sum(e[3] or 0 for e in island), None, None])
                    out.append(standing[-1])
    return sorted(map(tuple, out), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "user long, batch long, second long, h long, island string, stretch string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(("gap", "seed"), [(240, 1), (10, 2), (0, 3)])
def test_brute_force(spark, gap, seed):
    """Late, early, tied and repeated events, times below zero, one user with a third of all rows."""
    rng = random.Random(seed)
    events = [(rng.choice([0, 0, 0, rng.randrange(9)]), rng.randrange(-1, 5), rng.randrange(-900, 9000), rng.choice([None, rng.randrange(2**32)])) for _ in range(300)]
    events += [(0, 2, 77, 5)] * 100 + [(20, 3, 240 * i, 1) for i in range(9)] + [(21, i % 3, 241 * i, 1) for i in range(9)]
    nulls = [(None, 1, 1, 1), (1, None, 1, 1), (1, 1, None, 1)]
    assert rows_of(late_sessions.late_sessions(frame(spark, events + nulls), gap)) == brute(events, gap)


def test_steps(spark):
    """Without a horizon all sessions stand; a batch counts once; a new store goes on where one stopped."""
    rng = random.Random(5)
    events = [(rng.randrange(3), rng.randrange(4), rng.randrange(5000), 1) for _ in range(80)]
    micro = late_sessions.micro_sessions(frame(spark, events), 240)
    path = scratch.new_path(spark, "sessions")
    store = late_sessions.SessionStore(spark, path)
    assert store.versions().count() == 0
    assert store.merge(0, micro.where("batch = 0").drop("batch")) and store.merge(1, micro.where("batch = 1").drop("batch"))
    assert not store.merge(1, micro.where("batch = 1").drop("batch")) and not store.merge(0, micro.drop("batch"))
    # A step that its driver didn't finish.
    micro.selectExpr("user", "batch", *["1L AS " + c for c in late_sessions._FIELDS[1:]], "true AS done").write.partitionBy("done").parquet(f"{path}/step=000000002of9")
    fs, p = scratch.filesystem(spark, f"{path}/step=000000002of9/_SUCCESS")
    fs.delete(p, False)
    again = late_sessions.SessionStore(spark, path)
    assert rows_of(again.versions()) == brute([e for e in events if e[1] < 2], 240)
    fs.delete(p.getParent(), True)
    assert again.merge(2, micro.where("batch = 2").drop("batch")) and again.merge(3, micro.where("batch = 3").drop("batch"), 10**9)
    assert rows_of(again.versions()) == brute(events, 240)


def test_goes_on(spark):
    """After a driver that stopped between two batches."""
    rows = [(1, 0, 5, 1), (1, 1, 100, 1), (1, 2, 9, 1)]
    path = scratch.new_path(spark, "sessions")
    micro = late_sessions.micro_sessions(frame(spark, rows), 240)
    assert late_sessions.SessionStore(spark, path).merge(0, micro.where("batch = 0").drop("batch"), 9)
    assert rows_of(late_sessions.late_sessions(frame(spark, rows), path=path)) == brute(rows, 240)


def test_empty(spark):
    assert late_sessions.late_sessions(frame(spark, [])).count() == 0


def test_events(spark):
    """The fold of ids against zlib, with nulls, repeats, numbers below zero and a turn whose time no long holds."""
    rows = [(7, 0), (7, 0), (None, 1), (8, None), (-9, 3), (12345, 399), (1, -40), (3, 2**62)]
    got = late_sessions.conversation_events(spark.createDataFrame([(*r, "t", 1) for r in rows], "conv_id long, turn long, text string, h long")).collect()
    want = []
    for conv, turn in rows:
        if conv is not None and turn is not None and turn < 2**60:
            c, h = zlib.crc32(str(conv).encode()), zlib.crc32(f"{conv}:{turn}".encode())
            second = c // 2 % 7200 + 300 * turn + h % 600
            want.append((2 * (conv // 8) + c % 2, second // 1800 + (h // 600 % 4 if h // 600 % 3 == 0 else 0), second, h))
    assert sorted(tuple(r) for r in got if r["second"] is not None) == sorted(want) and len(got) == len(want) + 1


def test_sql(spark):
    compare(queries.op11_late_sessions(spark, SF), connect(SF), queries.ORACLE_SQL["op11_late_sessions"])
