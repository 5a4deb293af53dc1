"""Operators on small hand-made tables: ties, nulls, empty inputs, late data."""

import datetime as dt
import os
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import ngrams, strip_html, tokens
from tessera.functions.vectors import cosine
from tessera.operators.asof import asof_join
from tessera.operators.cells import CellIndex
from tessera.operators.nearest import nearest
from tessera.operators.ranges import interval_join, overlap_join
from tessera.operators.sessions import sessionize
from tessera.operators.slices import with_slices
from tessera.operators.topk import top_k
from tessera.sources.files import read, write
from tessera.streaming.runner import drain
from tessera.streaming.sessions import closed_sessions


@pytest.mark.parametrize("strict", [True, False])
def test_asof_with_ties(spark, strict):
    rng = random.Random(3)
    left = [(i, rng.randrange(3), rng.randrange(20)) for i in range(60)]
    right = [(rng.randrange(3), rng.randrange(20), i) for i in range(40)]
    got = asof_join(spark.createDataFrame(left, "id int, k int, t int"), spark.createDataFrame(right, "k int, rt int, v int"), ["k"], "t", "rt", ["v"], strict)
    for r in got.collect():
        before = [(t, v) for k, t, v in right if k == r["k"] and (t < r["t"] or (not strict and t == r["t"]))]
        assert r["v"] == (max(before)[1] if before else None)
    assert got.count() == 60


def test_interval_join(spark):
    rng = random.Random(4)
    points = [(i, rng.uniform(0, 100)) for i in range(80)]
    spans = [(i, s := rng.uniform(0, 100), s + rng.uniform(-1, 20)) for i in range(40)]
    got = interval_join(spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(spans, "i int, a double, b double"), F.col("x"), F.col("a"), F.col("b"), 7.0)
    assert sorted((r["p"], r["i"]) for r in got.collect()) == sorted((p, i) for p, x in points for i, a, b in spans if a <= x < b)


def test_intervals_of_any_length(spark):
    """Lengths over many orders of magnitude, infinite ends, nulls and NaN, names that the join could use."""
    rng, inf, nan = random.Random(5), float("inf"), float("nan")
    points = [(i, rng.choice([1, -1]) * 10 ** rng.uniform(-3, 12)) for i in range(60)] + [(60, None), (61, nan), (62, 0.0), (63, inf), (64, -inf)]
    spans = [(i, s := rng.choice([1, -1]) * 10 ** rng.uniform(-3, 12), s + 10 ** rng.uniform(-4, 13)) for i in range(60)]
    spans += [(60, -inf, inf), (61, 0.0, inf), (62, -inf, -1.0), (63, None, 5.0), (64, 1.0, nan), (65, 5.0, 5.0), (66, 0.0, 3e9)]
    left = spark.createDataFrame([(*p, "x") for p in points], "p int, x double, _bucket string")
    right = spark.createDataFrame([(*r, "y", "z") for r in spans], "i int, a double, b double, level string, bucket string")
    got = interval_join(left, right, F.col("x"), F.col("a"), F.col("b"), 1.0)
    assert got.columns == [*left.columns, *right.columns]
    want = sorted((p, i) for p, x in points for i, a, b in spans if None not in (x, a, b) and a <= x < b)
    assert sorted((r["p"], r["i"]) for r in got.collect()) == want
    longs = interval_join(spark.range(3).select((F.col("id") * 10**9).alias("t")), spark.createDataFrame([(0, 3 * 10**9)], "a long, b long"), F.col("t"), F.col("a"), F.col("b"), 1)
    assert longs.count() == 3


def test_overlaps(spark):
    rng = random.Random(6)
    make = lambda n: [(i, rng.randrange(2), s := rng.randrange(200), s + rng.choice([0, 1, 5, 90])) for i in range(n)]
    left, right = make(60), make(50)
    a, b = spark.createDataFrame(left, "i int, k int, s int, e int"), spark.createDataFrame(right, "j int, k int, t int, f int")
    got = overlap_join(a, b, (F.col("s"), F.col("e")), (F.col("t"), F.col("f")), 4, ["k"])
    assert sorted((r["i"], r["j"]) for r in got.collect()) == sorted((i, j) for i, k, s, e in left for j, m, t, f in right if k == m and max(s, t) < min(e, f))


def test_nearest_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (5, None)], "id long, v array<double>")
    got = nearest(rows.where("id = 2"), rows, 2, "id", "v", query_block=1, row_block=2).collect()
    assert [(r["id"], r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1), (3, 2)]
    assert nearest(rows.where("id = 9"), rows, 2, "id", "v").count() == 0


@pytest.mark.parametrize("held", [100, 4])
def test_nearest_against_all_pairs(spark, held):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(60)]  # many ties
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in nearest(df.where("id % 7 = 0"), df, 4, "id", "v", query_block=3, row_block=13, held=held).collect()}
    assert len(got) == 4 * len(rows[::7])
    for q, v in rows[::7]:
        want = sorted((-sum(a * b for a, b in zip(v, x, strict=True)), i) for i, x in rows if i != q)[:4]
        assert [got[q, k] for k in range(1, 5)] == [i for _, i in want]


def test_cells_find_neighbours(spark, tmp_path):
    """Every row is in the stored index; all cells give the exact answer, fewer give most of it; null vectors and an empty table."""
    rng = random.Random(3)
    centres = [[rng.gauss(0, 4) for _ in range(5)] for _ in range(12)]
    rows = [(i, [rng.gauss(c, 1) for c in rng.choice(centres)]) for i in range(1500)] + [(2000, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    built = CellIndex.build(df, "id", "v", f"{tmp_path}/index", cells=16, sample=1000)
    index = CellIndex.read(spark, f"{tmp_path}/index")
    assert index.rows.count() == 1500 and len(index.centres) == 16 and (index.centres == built.centres).all()
    asked = df.where("id % 50 = 0")
    floats = df.select("id", F.col("v").cast("array<float>").alias("v"))
    exact = {(r["query_id"], r["rank"]): r["id"] for r in nearest(floats.where("id % 50 = 0"), floats, 4, "id", "v").collect()}
    every = {(r["query_id"], r["rank"]): r["id"] for r in index.search(asked, 4, "id", "v", 16, row_block=100, query_block=7).collect()}
    assert every == exact and len(exact) == 120
    probes = index.probes(4, 0.95)
    assert probes < 16
    some = {(r["query_id"], r["id"]) for r in index.search(asked, 4, "id", "v", probes).collect()}
    assert len(some & {(q, i) for (q, _), i in exact.items()}) >= 0.9 * len(exact)
    empty = CellIndex.build(df.where("false"), "id", "v", f"{tmp_path}/none")
    assert empty.search(asked.where("false"), 4, "id", "v", empty.probes(4, 0.9)).count() == 0


def test_sessions_and_top_k(spark):
    t0 = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(1, t0), (1, t0 + dt.timedelta(seconds=9)), (1, t0 + dt.timedelta(seconds=19)), (2, t0)], "u int, ts timestamp_ntz")
    assert sorted((r["u"], r["session"]) for r in sessionize(e, ["u"], "ts", 10).collect()) == [(1, 1), (1, 1), (1, 2), (2, 1)]
    assert top_k(e, 1, [F.col("ts")], ["u"]).count() == 2
    assert top_k(e.where("false"), 1, [F.col("ts")], ["u"]).count() == 0


def _uneven(rng, n):
    """Rows of which two keys, one of them null, have most; times repeat and may be missing."""
    return [(i, rng.choice([1, 1, 1, None, None, 2, 3]), rng.choice([None, *range(40)])) for i in range(n)]


def test_slices_cut_keys_with_many_rows(spark):
    rows = spark.createDataFrame(_uneven(random.Random(7), 700), "id int, k int, t int")
    cut, n = with_slices(rows, ["k"], "t", least=140, parts=8)
    got = cut.collect()
    assert n == 2 and {r["k"] for r in got if r["_cut"]} == {1, None} and len(got) == 700
    assert all(r["_slice"] == 0 for r in got if r["k"] in (2, 3) or r["t"] is None)
    held, reach = {}, {}
    for r in got:
        if r["_cut"] and r["t"] is not None:
            held[r["_slice"]] = held.get(r["_slice"], 0) + 1
            reach.setdefault(r["_slice"], set()).add(r["t"])
    assert len(held) >= 6 and max(held.values()) <= 2 * sum(held.values()) / 8
    ordered = [reach[s] for s in sorted(reach)]
    assert all(max(a) < min(b) for a, b in zip(ordered, ordered[1:], strict=False))
    assert with_slices(rows, ["k"], "t", parts=8)[1] == 0 and with_slices(rows.where("false"), ["k"], "t", least=0, parts=8)[1] == 0


@pytest.mark.parametrize("strict", [True, False])
def test_asof_in_slices(spark, strict):
    rng = random.Random(8)
    left = spark.createDataFrame(_uneven(rng, 300), "id int, k int, t int")
    right = spark.createDataFrame([(k, t, i) for i, k, t in _uneven(rng, 60)], "k int, rt int, v int")
    whole, cut = (asof_join(left, right, ["k"], "t", "rt", ["v"], strict, least=least, parts=8).collect() for least in (10**6, 30))
    assert sorted(map(str, whole)) == sorted(map(str, cut)) and len(cut) == 300
    assert sum(r["v"] is not None for r in cut) > 200


def test_sessions_in_slices(spark):
    rng, t0 = random.Random(9), dt.datetime(2024, 3, 1)
    rows = [(i, k, None if t is None else t0 + dt.timedelta(seconds=t * rng.choice([1, 7, 30]))) for i, k, t in _uneven(rng, 400)]
    e = spark.createDataFrame(rows, "id int, k int, ts timestamp_ntz")
    whole, cut = (sessionize(e, ["k"], "ts", 6, ["id"], least=least, parts=8) for least in (10**6, 30))
    assert whole.schema == cut.schema
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))
    assert cut.agg(F.max("session")).first()[0] > 20


def test_text_and_vectors(spark):
    df = spark.createDataFrame([("Ab, cd ef", "<p>x</p><script>a<b</script> y"), (None, None)], "t string, h string")
    rows = df.select(tokens(F.col("t")).alias("w"), strip_html(F.col("h")).alias("h")).collect()
    assert rows[0]["w"] == ["ab", "cd", "ef"] and rows[0]["h"] == "x y" and rows[1]["w"] == []
    assert df.select(ngrams(tokens(F.col("t")), 2).alias("g")).collect()[0]["g"] == ["ab cd", "cd ef"]
    v = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in v.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, None]


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_files_round_trip(spark, tmp_path, kind):
    rows = [(1, 'a "quoted", line\nnext', 1.5, dt.datetime(2024, 2, 29, 1, 2, 3, 456)), (2, None, None, None), (3, "ü", -0.25, dt.datetime(1999, 1, 1))]
    schema = "id long, s string, x double, t timestamp_ntz"
    write(spark.createDataFrame(rows, schema), f"{tmp_path}/{kind}", kind)
    assert sorted(map(tuple, read(spark, f"{tmp_path}/{kind}", kind, schema).collect())) == rows


def test_partitioned_files_prune(spark, tmp_path):
    write(spark.range(10).withColumn("k", F.col("id") % 2), f"{tmp_path}/p", "parquet", ["k"])
    got = read(spark, f"{tmp_path}/p", "parquet", "id long, k long").where("k = 1")
    assert got.count() == 5
    assert "PartitionFilters: [isnotnull(k" in got._jdf.queryExecution().toString()


def test_late_events_are_dropped(spark, tmp_path):
    """Rows behind the watermark that held when an earlier micro-batch ended don't count."""
    t0 = dt.datetime(2024, 1, 1, 12)
    schema = "id long, ts timestamp"
    hour = dt.timedelta(hours=1)
    for i, rows in enumerate([[(1, t0), (2, t0 + 5 * hour)], [(3, t0 + 6 * hour)], [(4, t0 + hour / 60), (5, t0 + 9 * hour)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    for i in range(3):
        for f in os.listdir(f"{tmp_path}/in/{i}"):
            os.utime(f"{tmp_path}/in/{i}/{f}", (time.time() - 100 + 20 * i,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = drain(stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")))
    rows = {r["w"]["start"].hour: r["n"] for r in out.collect()}
    assert rows[12] == 1 and rows[17] == 1


def test_timers_close_sessions(spark, tmp_path):
    """A session over two micro-batches counts once; a row that is behind the watermark, and open sessions, don't."""
    t0, minute = dt.datetime(2024, 1, 1, 12), dt.timedelta(minutes=1)
    at = [[(1, 10), (1, 0), (2, 0), (1, 50)], [(1, 60), (None, 60)], [(2, 300)], [(2, 5), (3, 400)]]
    for i, rows in enumerate(at):
        spark.createDataFrame([(u, t0 + m * minute) for u, m in rows], "u long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        for f in os.listdir(f"{tmp_path}/in/{i}"):
            os.utime(f"{tmp_path}/in/{i}/{f}", (time.time() - 100 + 20 * i,) * 2)
    stream = spark.readStream.schema("u long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = drain(closed_sessions(stream.withWatermark("ts", "1 hour"), "u", "ts", 1800))
    got = sorted((r["u"], (r["start"] - t0) / minute, (r["end"] - t0) / minute, r["n"]) for r in out.collect())
    assert got == [(1, 0, 40, 2), (1, 50, 90, 2), (2, 0, 30, 1), (2, 300, 330, 1)]


def test_user_functions_take_nulls():
    from tessera.functions.user import running_balance

    got = running_balance()(pd.DataFrame({"user_id": [1, 1, 1], "event_id": [2, 1, 3], "cents": [-5, 3, 4]}))
    assert got["balance"].tolist() == [3, 0, 4]
