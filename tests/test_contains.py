import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import contains
from tessera.operators.contains import substring_join


def pairs(spark, texts, patterns):
    left = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "i int, t string, digest string")
    right = spark.createDataFrame([(p, 1) for p in patterns], "p string, size int")
    got = substring_join(left, right, F.col("t"), F.col("p"))
    assert got.columns == [*left.columns, *right.columns]
    return sorted((r["i"], r["p"]) for r in got.collect())


def brute(texts, patterns):
    return sorted((i, p) for i, t in enumerate(texts) for p in patterns if t is not None and p is not None and p in t)


def test_patterns_of_all_lengths(spark):
    """Empty, short and equal patterns, nulls, texts whose ends touch, several scripts, columns of clashing names."""
    texts = ["TIN plate", "a tin", "", "nickel", "TI", None, "ab", "cd", "日本語 text", "x" * 300, "é"]
    patterns = ["TIN", "TI", "n", "", "nickel", "plate", "absent", None, "abcd", "bc", "本語", "x" * 299, "x" * 301, "TIN", "\u00e9", "e"]
    assert pairs(spark, texts, patterns) == brute(texts, patterns)
    assert pairs(spark, texts, []) == [] and pairs(spark, [], patterns) == []


@pytest.mark.parametrize("once", [10**6, 7])
def test_random_texts(spark, monkeypatch, once):
    """Few letters, so that patterns share their starts and stand many times; in one pass and in several."""
    rng = random.Random(6)
    monkeypatch.setattr(contains, "_AT_ONCE", once)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(60))) for _ in range(40)]
    patterns = list({"".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(50)})
    assert pairs(spark, texts, patterns) == brute(texts, patterns)


@pytest.mark.parametrize("stretch", [1, 7, 64])
def test_stretches(monkeypatch, stretch):
    """Matches across the borders of stretches and of slices of hits."""
    rng = random.Random(stretch)
    monkeypatch.setattr(contains, "_STRETCH", stretch)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(50))) for _ in range(9)]
    wanted = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))) for _ in range(40)})
    prints = np.array([contains._print(p) if p else (0, 0) for p in wanted], np.uint64)
    import hashlib

    found = contains.Patterns(np.array([len(p) for p in wanted]), prints[:, 0], prints[:, 1], np.array([hashlib.sha256(p).digest() for p in wanted], object))
    offsets = np.cumsum([0, *map(len, texts)])
    got = found.find(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert got == sorted((i, k) for i, t in enumerate(texts) for k, p in enumerate(wanted) if p in t)


def test_equal_prints_are_told_apart(monkeypatch):
    """Where hashes say that all is equal, the bytes decide."""
    monkeypatch.setattr(contains, "_VALUES", np.ones(256, np.uint64))
    import hashlib

    first, last = contains._print(b"abcd")
    found = contains.Patterns(np.array([4]), np.array([first], np.uint64), np.array([last], np.uint64), np.array([hashlib.sha256(b"abcd").digest()], object))
    data = b"xxxxyyabcdzzzz"
    assert found.find(np.frombuffer(data, np.uint8), np.array([0, 4, 14])) == [(1, 0)]
    assert found.find(np.frombuffer(data, np.uint8), np.array([0, 8, 14])) == []


def test_time_is_linear(spark):
    """Ten million characters in seconds, and ten times a text in about ten times the time."""
    rng = np.random.default_rng(2)
    text = rng.integers(97, 123, 10_000_000).astype(np.uint8).tobytes().decode()
    wanted = [text[i : i + n] for i, n in ((0, 5), (9_999_990, 10), (5_000_000, 3000), (1_234_567, 1 << 20))] + ["absent" * 9]
    right = spark.createDataFrame([(p,) for p in wanted], "p string")
    took = []
    for size in (1_000_000, 10_000_000):
        left = spark.createDataFrame([(text[-size:],)], "t string")
        start = time.perf_counter()
        n = substring_join(left, right, F.col("t"), F.col("p"), []).count()
        took.append(time.perf_counter() - start)
        assert n == sum(p in text[-size:] for p in wanted)
    assert took[1] < 30 and took[1] < 20 * took[0]
