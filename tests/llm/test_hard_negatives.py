import math
import random

import numpy as np
import pytest
from parity import compare, connect
from pyspark.sql import functions as F

from tessera.llm import hard_negatives, queries

SF = "/root/testdata/sf0.01"
EXTRA = ["id", "cell", "block", "row", "score", "raw"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], "vec_id long, label int, embedding array<float>, " + ", ".join(f"{c} string" for c in EXTRA))


def brute(rows, every, positives=5, negatives=5, least=80):
    sound = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = label, [math.floor(256 * float(np.float32(x))) for x in v]
        sound[i] = min(sound.get(i, row), row)
    out = []
    for a, (label, v) in sound.items():
        if a % every:
            continue
        s = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i) for i, (_, w) in sound.items() if i != a)
        for ps, p in [x for x in s if sound[x[1]][0] == label][:positives]:
            fits = [x for x in s if sound[x[1]][0] != label and least * -ps <= 100 * -x[0] <= 100 * -ps]
            out += [(a, p, k, n, -ps, -ns) for k, (ns, n) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(df, every, **options):
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("id") % every == 0, **options).collect()))


@pytest.fixture(scope="module")
def clustered():
    """Near and far groups, many ties, one label with a third of all rows."""
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(7)]
    rows = []
    for i in range(900):
        c = rng.choice(centres)
        rows.append((i, 0 if i % 3 == 0 else rng.randrange(40), [round(x + rng.gauss(0, 0.3), 1) for x in c]))
    return rows


@pytest.mark.parametrize("options", [{"sample": 0}, {"block": 100, "sample": 300}, {"block": 40, "cells": 4}])
def test_brute_force(spark, clustered, options):
    assert mined(frame(spark, clustered), 20, **options) == brute(clustered, 20)


def test_joined_anchors(spark, clustered, monkeypatch):
    """Beyond the bound of the broadcast."""
    monkeypatch.setattr(hard_negatives, "_BROADCAST", 0)
    assert mined(frame(spark, clustered), 10, block=100, positives=2, negatives=7, least=95) == brute(clustered, 10, 2, 7, 95)


def test_odd_rows(spark):
    """Nulls, non-finite components, empty and short vectors, repeated ids, ids below zero, scores below zero."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.5]), (2, 2, [0.9, 0.4]), (3, 2, None), (4, None, [1.0, 1.0]), (5, 2, [1.0, None]), (6, 2, [nan, 1.0]), (7, 2, [inf, 1.0]), (8, 2, [-inf, 1.0])]
    rows += [(9, 2, []), (10, 2, [0.85]), (11, 2, [0.85, 0.5, 7.0]), (11, 2, [0.85, 0.5, 7.0]), (12, 3, [0.8, 0.5]), (12, 2, [0.7, 0.5]), (None, 1, [1.0, 0.5]), (-100, 1, [-1.0, -0.5]), (-200, 5, [-1.0, 0.0]), (100, 9, [1.0, 1.0])]
    got = mined(frame(spark, rows), 100)
    assert got == brute(rows, 100) and got


def test_none(spark):
    assert mined(frame(spark, []), 100) == []
    assert mined(frame(spark, [(1, 1, [1.0]), (2, 2, [1.0])]), 100) == []


def test_too_large(spark):
    with pytest.raises(ValueError):
        mined(frame(spark, [(0, 1, [3e8]), (1, 1, [1.0])]), 100)


def test_pruned():
    """Whole groups go: far balls are never scored, and the answer is the same."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (16, 8))
    x = np.floor(centres.repeat(256, axis=0) + rng.normal(0, 3, (4096, 8)))
    label = np.zeros(4096, np.int64)
    order = hard_negatives._order(x, label)
    ids, x, label = np.arange(4096)[order], x[order], label[order]
    mine = slice(0, 4096, 4)
    s = hard_negatives.Search(ids[mine], label[mine], x[mine], np.full((1024, 1), -np.inf), np.full((1024, 1), np.inf), True, 5)
    s.meet(ids, label, x)
    score = x[mine] @ x.T
    assert s.scored < score.size / 5
    for n, (i, own) in enumerate(zip(ids[mine], label[mine], strict=True)):
        fits = np.flatnonzero((label == own) & (ids != i))
        best = fits[np.lexsort((ids[fits], -score[n, fits]))][:5]
        assert s.found[s.found[:, 0] == n, 2].tolist() == ids[best].tolist()


def test_sql(spark):
    compare(queries.op12_hard_negatives(spark, SF), connect(SF), queries.ORACLE_SQL["op12_hard_negatives"])
