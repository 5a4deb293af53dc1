import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import mixing, queries

SF = "/root/testdata/sf0.01"


def words(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def check(rows, docs, cap=3.0):
    """docs: (text, source) of all rows in any order; rows in any order."""
    size, smallest = defaultdict(int), {}
    for t, s in docs:
        size[s] += words(t)
        if words(t):
            smallest[s] = min(smallest.get(s, 1 << 60), words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    total, free, target = sum(size.values()), set(order), {}
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap * size[s]}
        target |= {s: cap * size[s] for s in over} if over else {s: weight[s] * level for s in free}
        free = free - over if over else set()
    taken = defaultdict(int)
    for r, s in rows:
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s], rel=1e-9)
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[s] += r["taken"]
    return {s: (taken[s] - target[s], smallest.get(s, 0)) for s in order}


def test_query(spark):
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op6_mixing(spark, SF).collect()
    assert {r["doc_id"]: r["size"] for r in rows} == {i: words(t) for i, (t, _) in docs.items()}
    for error, smallest in check([(r, docs[r["doc_id"]][1]) for r in rows], docs.values()).values():
        assert abs(error) <= 100 + smallest
    again = queries.op6_mixing(spark, SF).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_hard_rows(docs_of, corpus):
    docs = [r for r in corpus if r[0] not in (5, None)]
    source = {r[0]: r[3] for r in docs}
    rows = mixing.mix(docs_of(docs)).collect()
    assert len(rows) == len(docs)
    check([(r, source[r["doc_id"]]) for r in rows], [(t, s) for _, t, _, s in docs])


def test_hot_class(spark):
    """Many equal documents of one size, and sources of one document."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 2990, "a").otherwise(F.concat(F.lit("z"), F.col("id").cast("string"))).alias("source"))
    rows = mixing.mix(docs, parts=7).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    errors = check([(r, source[r["doc_id"]]) for r in rows], [("one two three", s) for s in source.values()])
    assert all(abs(e) <= 3 for e, _ in errors.values())


def test_empty_and_wordless(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    rows = mixing.mix(docs_of([(1, None), (2, " ")])).collect()
    assert [(r["target"], r["taken"]) for r in rows] == [(0.0, 0), (0.0, 0)]


def test_two_margins(spark):
    """The tilt meets constraints on both margins at once."""
    cells = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 30.0), ("b", "x", 40.0), ("b", "y", 20.0)], "s string, l string, mass double")
    goals = {"s": {"a": 60.0, "b": 40.0}, "l": {"x": 30.0, "y": 70.0}}
    tilt = mixing.entropy_balance(cells, ["s", "l"], goals, "mass", tolerance=1e-9)
    import math

    got = [(s, l, m * math.exp(tilt["s"][s] + tilt["l"][l])) for s, l, m in map(tuple, cells.collect())]
    for i, margin in enumerate("sl"):
        for v, goal in goals[margin].items():
            assert sum(r[2] for r in got if r[i] == v) == pytest.approx(goal, rel=1e-6)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(1, 3)), min_size=1, max_size=12))
def test_water_fill(pairs):
    sizes, weights = zip(*pairs, strict=True)
    got = mixing.water_fill(sizes, weights, 3.0)
    assert sum(got) == pytest.approx(sum(sizes)) and all(g <= 3 * s + 1e-6 for g, s in zip(got, sizes, strict=True))
    free = [g / w for g, s, w in zip(got, sizes, weights, strict=True) if g < 3 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))


def test_margins_by_proportional_fitting(spark):
    """Two margins at once, stepped on the driver and over a table, against iterative proportional fitting."""
    rng = np.random.default_rng(5)
    mass = rng.integers(1, 100, (4, 3)).astype(float)
    goal_a, goal_b = mass.sum(axis=1) * [2, 0.5, 1, 1], None
    goal_b = mass.sum(axis=0) * goal_a.sum() / mass.sum()
    rates = np.ones((4, 3))
    for _ in range(5000):
        rates *= (goal_a / (mass * rates).sum(axis=1))[:, None]
        rates *= goal_b / (mass * rates).sum(axis=0)
    cells = spark.createDataFrame([(f"a{i}", f"b{j}", float(mass[i, j]) / 2) for i in range(4) for j in range(3)] * 2, "a string, b string, m double")
    targets = {"a": {f"a{i}": goal_a[i] for i in range(4)}, "b": {f"b{j}": goal_b[j] for j in range(3)}}
    for held in (100, 0):
        tilt = mixing.entropy_balance(cells, ["a", "b"], targets, "m", held=held)
        got = np.exp([[tilt["a"][f"a{i}"] + tilt["b"][f"b{j}"] for j in range(3)] for i in range(4)])
        assert np.allclose(got, rates, rtol=1e-6)
    with pytest.raises(RuntimeError, match="off by"):
        mixing.entropy_balance(cells, ["a", "b"], {"a": targets["a"], "b": {k: 2 * v for k, v in targets["b"].items()}}, "m")
