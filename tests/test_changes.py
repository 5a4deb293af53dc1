"""Changes by key against plain Python: hot keys, late and repeated changes, ties, nulls, deletions, clashing names."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.changes import apply_changes, history, sayings

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, t timestamp_ntz, seq long, id long, op string, v int, w string, said string, cut int, key0 int"


def _rows(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.choice(["hot"] * 8 + ["a", "b", "c", None])
        t = None if rng.random() < 0.03 else T0 + dt.timedelta(hours=rng.randrange(40))
        out.append((k, t, rng.choice([None, 1, 2, 3]), i, rng.choice(["I", "U", "U", "U", "D", None]), rng.choice([1, 1, 2, None]), rng.choice(["x", None]), "s", 1, 2))
    return out + out[: n // 5]


def _said(rows):
    """The value of each key and time, by the greatest of (seq, id), nulls least."""
    best = {}
    for k, t, seq, i, op, v, w, *_ in rows:
        if k is None or t is None:
            continue
        rank = (seq is not None, seq or 0, i)
        if (k, t) not in best or rank > best[k, t][0]:
            best[k, t] = rank, None if op == "D" else (v, w)
    return {at: said for at, (_, said) in best.items()}


def _versions(rows):
    said, out = _said(rows), []
    for k in {k for k, _ in said}:
        now, since = None, None
        for t in sorted(t for g, t in said if g == k):
            if said[k, t] != now:
                if now is not None:
                    out.append((k, since, t, *now))
                now, since = said[k, t], t
        if now is not None:
            out.append((k, since, None, *now))
    return out


def _order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize(("least", "parts"), [(10**6, None), (10, 3), (10, 7)])
def test_history(spark, least, parts):
    rows = _rows(300, 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = history(df, ["k"], "t", ["seq", "id"], ["v", "w"], "op = 'D'", least=least, parts=parts)
    assert got.columns == ["k", "valid_from", "valid_to", "v", "w"]
    assert _order(got.collect()) == _order(_versions(rows))


def test_versions_over_slices_without_change(spark):
    """A value that many slices only repeat is one version, and a deletion closes it slices later."""
    rows = [("hot", T0 + dt.timedelta(hours=h), 1, h, "D" if h == 90 else "U", 7 if h else 1, "x", "", 0, 0) for h in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = history(df, ["k"], "t", ["seq", "id"], ["v", "w"], F.col("op") == "D", least=10, parts=9)
    assert _order(got.collect()) == _order(_versions(rows))
    assert got.count() == 3


def test_columns_named_like_the_operator_s_own(spark):
    rows = _rows(200, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    got = history(df, ["k"], "t", ["seq", "id"], ["said", "cut"], "op = 'D'", least=10, parts=3)
    plain = [(*r[:5], r[7], r[8], *r[7:]) for r in rows]
    assert _order(got.collect()) == _order(_versions(plain))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert history(df, ["k"], "t", ["seq"], ["v"], "op = 'D'").count() == 0
    assert sayings(df, ["k"], "t", ["seq"], ["v"], "op = 'D'").count() == 0
    base = spark.createDataFrame([("a", T0, 1, "n")], "k string, since timestamp_ntz, v int, latest string")
    assert apply_changes(base, df, ["k"], "since", "t", ["seq"], ["v"], "op = 'D'").collect() == base.collect()


def test_state(spark):
    """Late changes alter nothing, rows of a key are changed alike, a second run changes nothing."""
    rng = random.Random(7)
    changes = [r for r in _rows(60, 8) if r[0] != "c"] + [("new", T0, 1, 900, "I", 5, "y", "", 0, 0), ("gone", T0, 1, 901, "D", 5, "y", "", 0, 0)]
    base = [(k, rng.choice([None, T0, T0 + dt.timedelta(hours=100)]), rng.randrange(9), f"n{i}", "z") for i, k in enumerate(["hot"] * 5 + ["a", "c", None, "gone", "gone"])]
    base[-1] = (*base[-1][:1], T0 + dt.timedelta(days=9), *base[-1][2:])
    schema = "k string, since timestamp_ntz, v int, last string, key0 string"
    cdf, bdf = spark.createDataFrame(changes, SCHEMA), spark.createDataFrame(base, schema)
    said = _said(changes)
    last = {k: max((t, said[k, t]) for g, t in said if g == k)[:1] for k in {k for k, _ in said}}
    want = []
    for k, since, v, name, z in base:
        t = last.get(k, (None,))[0]
        if t is not None and (since is None or t > since):
            if said[k, t] is not None:
                want.append((k, t, said[k, t][0], name, z))
        else:
            want.append((k, since, v, name, z))
    held = {r[0] for r in base}
    want += [(k, t, said[k, t][0], None, None) for k, (t,) in last.items() if k not in held and said[k, t] is not None]
    args = (["k"], "since", "t", ["seq", "id"], ["v"], "op = 'D'")
    got = apply_changes(bdf, cdf, *args)
    assert got.schema.simpleString() == bdf.schema.simpleString()
    assert _order(got.collect()) == _order(want)
    assert _order(apply_changes(got, cdf, *args).collect()) == _order(want)
