import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.similarity import shingles, similar_sets


def brute(rows, least):
    sets = {i: frozenset(x for x in t if x is not None) for i, t in rows if t}
    sets = {i: s for i, s in sets.items() if s}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    reps = sorted(first.items(), key=lambda x: x[1])
    pairs = [(i, j, len(a & b), len(a | b)) for a, i in reps for b, j in reps if i < j and len(a & b) >= least * len(a | b) - 1e-9]
    return sorted((i, first[s]) for i, s in sets.items()), sorted(pairs)


@pytest.mark.parametrize("least", [0.8, 0.5, 1.0])
def test_all_pairs(spark, least):
    """A family of near copies, equal sets, a token that all have, sets of one token, nulls, repeats."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(40)]
    rows = [(i, [t if rng.random() > 0.06 else f"x{rng.randrange(30)}" for t in base]) for i in range(60)]
    rows += [(100 + i, [rng.choice("abcdefghij") for _ in range(rng.randint(1, 12))]) for i in range(80)]
    rows += [(200 + i, ["common", *(f"u{i}-{k}" for k in range(rng.randint(0, 9)))]) for i in range(40)]
    rows += [(300, None), (301, []), (302, [None]), (303, [None, "a", "a"]), (304, base), (305, base[::-1] + base)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id int, t array<string>, token string, n int")
    members, pairs = similar_sets(df, "id", F.col("t"), least)
    want = brute(rows, least)
    assert sorted(map(tuple, members.collect())) == want[0]
    assert sorted(map(tuple, pairs.collect())) == want[1] and (want[1] or least == 1)


def test_no_pair_of_a_hot_token(spark):
    """Sets that share one token alone never meet: rare tokens fill their prefixes."""
    rows = [(i, ["hot", *(f"u{i}-{k}" for k in range(9))]) for i in range(300)]
    from tessera.operators.similarity import SimilarSets

    found = SimilarSets(spark.createDataFrame(rows, "id int, t array<string>"), "id", F.col("t"), 0.8)
    assert found.candidates().count() == 0 and found.pairs().count() == 0 and found.members().count() == 300


def test_repeated_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["a", "b"]), (1, ["c"]), (None, ["c"]), (None, ["d"])], "id int, t array<string>")
    members, pairs = similar_sets(df, "id", F.col("t"), 0.8)
    assert sorted(map(str, map(tuple, members.collect()))) == sorted(map(str, [(1, 1), (1, 1), (1, 1), (None, 1), (None, None)])) and pairs.count() == 0
    assert [x.count() for x in similar_sets(df.where("false"), "id", F.col("t"), 0.8)] == [0, 0]
    with pytest.raises(ValueError):
        similar_sets(df, "id", F.col("t"), 0)


def test_shingles(spark):
    df = spark.createDataFrame([(" a b\tc ",), ("a  b\nc d e f",), ("",), (" \n",), (None,)], "t string")
    assert [r[0] for r in df.select(shingles(F.col("t"), 5)).collect()] == [["a b c"], ["a b c d e", "b c d e f"], [], [], []]


def test_little_moves(spark):
    """A token is shuffled once, as two numbers, and tokens of sets that meet nothing not at all: 30 bytes a token suffice."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(600)) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *(f"{t} more" for t in texts[:4])])], "id long, t string")
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def moved():
        bus.waitUntilEmpty(30_000)
        return store.executorList(True).head().totalShuffleWrite()

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = moved()
        assert similar_sets(df, "id", shingles(F.col("t"), 5), 0.8)[1].count() == 4
        each = (moved() - before) / (596 * 404)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert each < 30, each
