"""Quantiles, ranks, running sums, frames and reachability with hot keys, ties, nulls and clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.asof import asof_join
from tessera.operators.ordered import frame_counts, ranks, running_totals
from tessera.operators.quantiles import exact_quantiles
from tessera.operators.reach import reachable, reachable_through
from tessera.operators.sessions import sessionize


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles(spark, accuracy):
    rng = random.Random(1)
    rows = [("hot", rng.choice([rng.gauss(0, 1), 7.0, 1e300, -1e-300])) for _ in range(2000)] + [(None, float(i)) for i in range(7)] + [("one", 5.0), ("none", None), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame([(k, v, "x", "y") for k, v in rows], "k string, v double, i string, lo string")
    wanted = (0.0, 0.013, 0.25, 0.5, 0.9, 1.0)
    got = {(r["k"], r["fraction"]): r["quantile"] for r in exact_quantiles(df, ["k"], F.col("v"), wanted, accuracy).collect()}
    assert len(got) == 4 * len(wanted)
    for k in ("hot", None, "one", "two"):
        own = sorted(v for g, v in rows if g == k and v is not None)
        for f in wanted:
            at = f * (len(own) - 1)
            a, z = own[int(np.floor(at))], own[int(np.ceil(at))]
            assert got[k, f] == pytest.approx(a + (z - a) * (at - np.floor(at)), rel=1e-12), (k, f)
    every = exact_quantiles(df, [], F.col("v"), (0.5,), accuracy).collect()
    assert [r["quantile"] for r in every] == [np.median([v for _, v in rows if v is not None])]
    assert exact_quantiles(df.where("false"), ["k"], F.col("v"), (0.5,)).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_order_of_a_whole_table(spark, parts):
    """Ties over the borders of ranges, nulls, a value that a third of the rows has."""
    rng = random.Random(2)
    rows = [(i, rng.choice([5, None, rng.randrange(30)]), rng.choice([None, rng.randrange(100)])) for i in range(300)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "id int, x int, v long, at string, part string").repartition(5)
    got = {r["id"]: r for r in running_totals(df, ["x", "id"], {"s": "v"}, parts=parts).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    total = 0
    for place, (i, _, v) in enumerate(order, 1):
        total += v or 0
        assert (got[i]["position"], got[i]["s"]) == (place, total) and got[i]["at"] == "a"
    ranked = {r["id"]: r["rank"] for r in ranks(df, "x", "id", parts=parts).collect()}
    assert all(ranked[i] == 1 + sum((y is not None, y or 0) < (x is not None, x or 0) for _, y, _ in rows) for i, x, _ in rows)
    assert running_totals(df.where("false"), ["x", "id"], {"s": "v"}).count() == 0


def test_frames_of_hot_keys(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, None, 2, 3]), rng.choice([None, rng.randrange(60)])) for i in range(300)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "id int, k int, t long, number string, row string, key0 string")
    whole, cut = (frame_counts(df, ["k"], F.col("t"), 10, least=least, parts=8) for least in (10**6, 20))
    assert whole.columns == cut.columns == [*df.columns, "n"]
    want = {i: sum(m == k and (u is None if t is None else u is not None and t - 10 <= u <= t) for _, m, u in rows) for i, k, t in rows}
    for found in (whole, cut):
        assert {r["id"]: r["n"] for r in found.collect()} == want


def test_reach(spark):
    """A ring, a long path, a node that many lead to, an island, nulls and repeated edges."""
    edges = [(i, (i + 1) % 5) for i in range(5)] + [(i, i + 1) for i in range(10, 25)] + [(2, 10)] + [(i, 99) for i in range(10, 20)] + [(99, 0), (50, 51), (None, 3), (3, None), (0, 1)]
    got = reachable(spark.createDataFrame([(0,), (None,), (0,)], "node int"), spark.createDataFrame([(a, b, 1) for a, b in edges], "source int, target int, step int"))
    step, todo = {0: 0}, [0]
    for n in todo:
        for a, b in edges:
            if a == n and b is not None and b not in step:
                step[b] = step[n] + 1
                todo.append(b)
    assert dict(map(tuple, got.collect())) == step and max(step.values()) > 10


def test_reach_through_a_gate_of_very_many(spark, tmp_path):
    """A gate with 30,000 sources and as many targets stands for 900 million edges, as lines of one number in one sale do."""
    n = 30_000
    wide = [spark.range(1, n + 1).selectExpr("CAST(1 AS LONG) AS sale_id", f"CAST({k} AS INT) AS line_no", f"IF({k} = 1 AND id = 1, 0, id * 10 + {k}) AS item_id") for k in (1, 2, 3)]
    few = spark.createDataFrame([(2, 1, 12), (2, 2, 5), (3, 1, 5), (3, 2, 0), (4, 1, 7), (4, 2, None), (None, 2, 9), (5, None, 0)], "sale_id long, line_no int, item_id long")
    wide[0].unionByName(wide[1]).unionByName(wide[2]).unionByName(few).write.parquet(f"{tmp_path}/sale_lines.parquet")
    from tessera.plans.shop import item_steps

    got = dict(map(tuple, item_steps(spark, str(tmp_path)).collect()))
    assert got == {0: 0} | {i * 10 + 2: 1 for i in range(1, n + 1)} | {i * 10 + 3: 2 for i in range(1, n + 1)} | {5: 2}
    made = [(i, g) for i in range(6) for g in ("a", None)]
    through = reachable_through(spark.createDataFrame([(0,), (None,)], "node long"), spark.createDataFrame(made, "source long, gate string"), spark.createDataFrame([("a", 3), ("a", None), (None, 4)], "gate string, target long"))
    assert dict(map(tuple, through.collect())) == {0: 0, 3: 1}


def test_names_of_callers_stay(spark):
    """Columns with the names that operators would use for themselves."""
    names = ["_new", "_slice", "_cut", "cut", "slice", "new", "sum", "before", "key0", "found", "bounds"]
    rows = [(k, t, *["x"] * len(names)) for k in (1, 1, 1, 2) for t in range(30)]
    df = spark.createDataFrame(rows, "k int, s long, " + ", ".join(f"`{n}` string" for n in names)).withColumn("ts", F.timestamp_seconds("s"))
    for least in (10**6, 10):
        got = sessionize(df, ["k"], "ts", 5, least=least, parts=4)
        assert got.columns == [*df.columns, "session"] and all(r[n] == "x" for r in got.collect() for n in names)
    left = df.select(F.col("k").alias("t"), F.col("s").alias("side"), *names)
    right = df.select(F.col("k").alias("t"), F.col("s").alias("own"), F.lit(1).alias("last"))
    for least in (10**6, 10):
        found = asof_join(left, right, ["t"], "side", "own", ["last"], least=least, parts=4)
        assert found.columns == [*left.columns, "last"] and found.where("last IS NULL").count() == 4


def test_views_of_callers_stay(spark):
    from tessera.plans import aggregates, joins

    spark.range(3).createOrReplaceTempView("orders")
    joins.subqueries(spark, "/root/testdata/sf0.001").count()
    aggregates.grouping_sets(spark, "/root/testdata/sf0.001").count()
    assert spark.table("orders").count() == 3
    spark.catalog.dropTempView("orders")
