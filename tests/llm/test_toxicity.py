import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import texts, toxicity

SF = "/root/testdata/sf0.1"


def reference(counts, order, d):
    """log P(toxic) - log P(ordinary) of a word, by dictionaries."""
    own = [Counter(), Counter()]
    for c in (0, 1):
        for w, n in counts[c].items():
            s = b"\x01" + w + b"\x02"
            for i in range(1, len(s)):
                own[c][s[max(0, i - order + 1) : i + 1]] += n
    lower = defaultdict(set)
    longer = set(own[0]) | set(own[1])
    level = {g for g in longer if len(g) > 1}
    while level:
        nxt = set()
        for g in level:
            lower[g[1:]].add(g[0])
            if len(g) > 2:
                nxt.add(g[1:])
        level = nxt
    n = {g: len(x) for g, x in lower.items() if g}
    total, kinds = Counter(), Counter()
    for g, k in n.items():
        total[g[:-1]] += k
        kinds[g[:-1]] += 1

    def shared(g):
        p = 1 / 256
        for m in range(1, len(g) + 1):
            s = g[len(g) - m :]
            t = total[s[:-1]]
            if t:
                p = max(n.get(s, 0) - d, 0) / t + min(d * kinds[s[:-1]] / t, 1) * p
        return p

    def ratio(w):
        s, out = b"\x01" + w + b"\x02", 0.0
        for i in range(1, len(s)):
            g = s[max(0, i - order + 1) : i + 1]
            logs = []
            for c in (0, 1):
                at = [k for k in own[c] if k[:-1] == g[:-1]]
                t = sum(own[c][k] for k in at)
                p = shared(g[1:])
                logs.append(math.log(max(own[c][g] - d, 0) / t + min(d * len(at) / t, 1) * p if t else p))
            out += logs[1] - logs[0]
        return out

    return ratio


@pytest.mark.parametrize("order", [2, 3, 5])
def test_against_dictionaries(spark, order):
    rng = random.Random(order)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(25)]
    rows = [(" ".join(rng.choices(words, k=8)) + rng.choice(["", " bad badly", " Bad!"]), rng.randrange(2)) for _ in range(30)]
    s = toxicity.Settings(order=order, bits=16)
    model = toxicity.fit(spark.createDataFrame(rows, "text string, toxic int"), s)
    counts = [Counter(), Counter()]
    for t, y in rows:
        counts[y].update(w.strip("!").lower().encode() for w in t.split())
    ratio = reference(counts, order, s.discount)
    tried = [*words, "bad", "badly", "new", "c" * 12, "ß"]
    (_, _, data, offsets), *_ = texts.blocks(pa.array([" ".join(tried)]))
    low, starts, ends, _ = toxicity._words(data, offsets)
    assert np.allclose(model.ratios(low, starts, ends), [ratio(w.encode()) for w in tried], atol=2e-3)


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    y, score = rows["toxic"] == 1, rows["score"].rank()
    area = (score[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert area > 0.93 and rows["predicted"][~y].mean() < 0.02 and rows["predicted"][y].mean() > 0.75
    assert got.count() == docs.count() and got.where("score < 0 OR score > 1 OR predicted <> int(score >= 0.5)").count() == 0


def test_held_out_labels_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: round(r["score"], 9) for r in toxicity.score(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_hard_rows(docs_of, corpus, spark):
    labels = spark.createDataFrame([(i, k % 2, 0) for k, (i, *_) in enumerate(corpus) if i is not None] + [(None, 1, 1), (3, None, None)], "doc_id long, toxic int, text int")
    rows = toxicity.score(docs_of(corpus), labels, settings=toxicity.Settings(bits=12)).collect()
    assert len(rows) == len(corpus) and all(0 <= r["score"] <= 1 for r in rows)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
    same = {r["score"] for r in rows if r["doc_id"] in (400, 401, 402)}
    assert len(same) == 1
    rows = toxicity.score(docs_of(corpus), labels.where("false"), settings=toxicity.Settings(bits=12)).collect()
    assert {r["score"] for r in rows} == {0.5}
    assert toxicity.score(docs_of([]), labels, settings=toxicity.Settings(bits=12)).count() == 0


def test_sequences_share_no_count(spark):
    """However small the index is, each sequence has its own counts."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    train = spark.createDataFrame([(" ".join(rng.choices(words, k=20)), rng.randrange(2)) for _ in range(60)], "text string, toxic int")
    (_, _, data, offsets), *_ = texts.blocks(pa.array([" ".join(words)]))
    low, starts, ends, _ = toxicity._words(data, offsets)
    small, large = (toxicity.fit(train, toxicity.Settings(bits=b)).ratios(low, starts, ends) for b in (6, 20))
    assert np.allclose(small, large, atol=1e-9)


def test_joined_tables(docs_of, corpus, spark):
    """Beyond the bound on what is broadcast, joins give the same figures, and the same scores from a wider grid."""
    labels = spark.createDataFrame([(i, k % 3 == 0) for k, (i, *_) in enumerate(corpus) if i is not None], "doc_id long, toxic boolean")
    docs = docs_of(corpus).withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.col("text"), F.lit(" ((badly!!!!! (bad)"))))
    one, two = (
        sorted(toxicity.score(docs, labels, settings=toxicity.Settings(sequences=n)).select("doc_id", "score").collect(), key=lambda r: (str(r["doc_id"]), r["score"])) for n in (4_000_000, 0)
    )
    assert [r["doc_id"] for r in one] == [r["doc_id"] for r in two]
    assert np.allclose([r["score"] for r in one], [r["score"] for r in two], atol=1e-6)
    table = toxicity.figures_of(docs.where("text IS NOT NULL").select("text", F.lit(1).alias("toxic")).limit(30), toxicity.Settings())
    by_key = table.groupBy("table", "key").count()
    assert by_key.where("count > 1").count() == 0


def test_punctuation_at_the_ends():
    (_, _, data, offsets), *_ = texts.blocks(pa.array(["((((word)))) word!!!!! ..... a-b -", "", "x"]))
    low, starts, ends, first = toxicity._words(data, offsets)
    raw = low.tobytes()
    assert [raw[a:b] for a, b in zip(starts, ends, strict=True)] == [b"word", b"word", b".", b"a-b", b"-", b"x"]
    assert first.tolist() == [0, 5, 5, 6]


def test_curve():
    """The logistic curve against plain gradient steps."""
    rng = np.random.default_rng(3)
    x, n = rng.normal(size=(30, 3)), rng.integers(1, 5, 30).astype(float)
    y = np.minimum(rng.integers(0, 5, 30), n).astype(float)
    design, w = np.column_stack([np.ones(30), x]), np.zeros(4)
    for _ in range(40_000):
        w -= 0.01 * (design.T @ (n / (1 + np.exp(-design @ w)) - y) + 1e-2 * w)
    assert np.allclose(toxicity.logistic(x, n, y), w, atol=1e-4)
